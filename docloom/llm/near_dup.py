"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Each text becomes a set of 64-bit hashes of its distinct five-word shingles. Texts with equal sets are one class;
   its smallest id stands for it.
2. BANDS x ROWS MinHash values give a class its band keys. At the similarity threshold a pair shares no band with
   probability (1 - 0.75**5)**50, about 1e-6; beyond it with less.
3. Each bucket links its members to its centre only, the one that shares most buckets, so a bucket of m members makes
   m - 1 pairs, and all buckets at most BANDS pairs a class.
4. A pair's signatures are compared in batches. After each batch the posterior (uniform prior) of the similarity is
   bounded; a pair goes once the threshold is missed with probability 1 - MISS. Survivors are confirmed on full sets.
   Over the 12 looks, a pair right at the threshold of 0.75 is lost with probability 9.5e-6.
5. Buckets whose members are not yet one component are looked at again, in tiles of bounded size: members of different
   components are compared by the same sequential test. What has a survivor meets again in the same tile, now with its
   full set; there survivors are confirmed, and only links that join two components leave the tile. So every pair that
   shares a band has been tested, pruned or found connected, no pair is capped away, and no pair is a row before it is
   known to be a link: a tile of t rows returns fewer than t links. Rows sent to tiles grow with the members of a
   bucket, times its number of tiles beyond one.

Defined results: words are what [\\x20\\x09-\\x0D] separates, A-Z lower-cased; fewer than five words make one shingle of
the whole sequence; a null text or one without words has an empty set and is linked with nothing. Rows with the same
doc_id are linked by the smallest of their texts, each with its own set size and the same component. A null doc_id is
kept, linked with nothing, with a null component. Very long texts are hashed in slices of SLICE bytes and weigh more in
a tile. Other columns, whatever their names, don't matter here and aren't returned. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.perfect_hash import U, mix
from docloom.storage import cut

WORDS, BANDS, ROWS = 5, 50, 5
BATCH, BATCHES = 64, 12
MISS = 1e-6
#: Weight of one side of a tile: a class weighs 1, and 1 more for each HEAVY shingles (16 KB) of its set.
TILE, HEAVY = 1024, 2048
CHUNK = 64
#: Pairs of rows that a task compares at once.
PAIRS = 1 << 16
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_coef = np.random.default_rng(11)
MUL = _coef.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
ADD = _coef.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
MUL2 = _coef.integers(0, 2**63, BATCH * BATCHES, dtype=np.uint64) * U(2) + U(1)
ADD2 = _coef.integers(0, 2**63, BATCH * BATCHES, dtype=np.uint64)


class Words:
    """64-bit hashes of a text's words: a polynomial in the bytes, read off prefix sums and mixed."""

    def __init__(self):
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(4096, 1 << int(n).bit_length())
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate(([U(1)], np.full(size, U(BASE)))), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate(([U(1)], np.full(size, U(pow(BASE, -1, 2**64))))), dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode().lower(), np.uint8)
        if len(data) <= SLICE:
            return self.of(data)
        out, at = [], 0
        while at < len(data):  # slices end before a space, or run on to the next one
            end, size = len(data), SLICE
            while at + size < len(data):
                gaps = np.flatnonzero(SPACE[data[at + 1 : at + size + 1]])
                if len(gaps):
                    end = at + 1 + int(gaps[-1])
                    break
                size *= 2
            out.append(self.of(data[at:end]))
            at = end
        return np.concatenate(out)

    def of(self, data: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.empty(0, np.uint64)
        self.grow(len(data) + 1)
        gap = np.concatenate(([True], SPACE[data], [True]))
        start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        with np.errstate(over="ignore"):
            sums = np.concatenate(([U(0)], np.cumsum((data.astype(np.uint64) + U(1)) * self.powers[: len(data)], dtype=np.uint64)))
            return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, U(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * U(0xC2B2AE3D27D4EB4F) + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set, taken in blocks so that a very long text needs little memory."""
    best = np.full(BANDS * ROWS, U(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            best = np.minimum(best, (own[at : at + 2048, None] * MUL + ADD).min(axis=0))
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys * U(0xC2B2AE3D27D4EB4F) + sig.reshape(BANDS, ROWS)[:, k])
    return keys.view(np.int64)


def short_signature(own: np.ndarray) -> bytes:
    """The values that verification compares, a byte each, from hash functions that the bands don't use."""
    best, mixed = np.full(BATCH * BATCHES, U(2**64 - 1)), mix(own ^ U(0x7F4A7C15))
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 1024):
            best = np.minimum(best, (mixed[at : at + 1024, None] * MUL2 + ADD2).min(axis=0))
    return (mix(best) >> U(56)).astype(np.uint8).tobytes()


SETS = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"
CHOSEN = "rep long, n_shingles long, signature binary, shingles binary"
FILTER_BITS = 1 << 27


def fingerprints(docs: DataFrame) -> DataFrame:
    """Set size, set hash and band keys of each row's text; nulls where the set is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                doc = None if doc is None else int(doc)
                own = shingles(words(text or ""))
                if len(own):
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8").tolist()
                    out.append((doc, len(own), c1, c2, band_keys(signature(own))))
                else:
                    out.append((doc, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "c1", "c2", "bands"]).astype({"doc_id": "Int64", "c1": "Int64", "c2": "Int64"})

    # The id goes in as a string, as pandas would turn a nullable long into a float.
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SETS)


def bit_filter(values: DataFrame):
    """A broadcast array of flags, at most FILTER_BITS, that is set at ``pmod(value, size)`` of every long in the only
    column of ``values``. Other values may share a flag; an exact step must follow."""
    name = values.columns[0]
    bits = 1 << 10
    while bits < min(FILTER_BITS, 16 * values.count()):
        bits *= 2
    at = values.select(F.pmod(F.col(name), F.lit(bits)).alias("bit"))
    words = at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    array = np.zeros(bits // 64, np.int64)
    array[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return values.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(array.view(np.uint8), bitorder="little").astype(bool)))


def flagged(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % (len(packed) * 8)
    return (packed[at >> 3] >> (7 - (at & 7))) & 1 == 1


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n_shingles, signature, shingles) of the documents in ``wanted`` (rep), read again from their texts.

    While the wanted ones have FILTER_BITS / 16 rows at most, a bit array sent to all tasks lets most other texts pass
    unread; those that share a bit with a wanted one are computed as well and left out by the joins that follow. Beyond
    it the texts are semi-joined with the wanted ids.
    """
    mark = F.xxhash64(F.col("rep").cast("string")).alias("mark")
    sent = bit_filter(wanted.select(mark)) if 16 * wanted.count() <= FILTER_BITS else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Words()
        for b in batches:
            if sent:
                b = b[flagged(sent.value, b["mark"].to_numpy(np.int64))]
            out = []
            for rep, text in zip(b["rep"], b["text"], strict=True):
                own = shingles(of(text or ""))
                if len(own):
                    out.append((int(rep), len(own), short_signature(own), own.tobytes()))
            yield pd.DataFrame(out, columns=["rep", "n_shingles", "signature", "shingles"])

    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("rep"), "text")
    if not sent:
        ids = ids.join(wanted.select(F.col("rep").cast("string").alias("rep")), "rep", "left_semi")
    return cut(ids.withColumn("mark", mark).mapInPandas(run, CHOSEN), "chosen")


def least_matches(threshold: float) -> list[int]:
    """Matches needed after each batch: with fewer, the similarity reaches the threshold with probability under MISS."""
    s = (np.arange(20000) + 0.5) / 20000
    equal = s + (1 - s) / 256  # different minima share their byte that often
    needed, out = 0, []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        for m in range(needed, n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= MISS:
                needed = m
                break
        out.append(needed)
    return out


def may_reach(a: np.ndarray, b: np.ndarray, needed: list[int], p: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of signature rows (a[p], b[q]) survive the sequential test."""
    p, q = (np.arange(len(a)), np.arange(len(b))) if p is None else (p, q)
    alive, matches = np.arange(len(p)), np.zeros(len(p), np.int32)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[p[alive], part] == b[q[alive], part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def as_rows(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, BATCH * BATCHES)


def pruned(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the sequential test and the sizes leave."""
    needed = least_matches(threshold)
    of = classes.select("rep", "n_shingles", "signature")
    rows = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.iloc[may_reach(as_rows(x["sa"]), as_rows(x["sb"]), needed)][["a", "b"]]

    return rows.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets.

    A set met in many pairs is sent once for CHUNK of them, so that a popular one is dealt over many tasks.
    """
    popular = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") > CHUNK), "popular")
    numbered = pairs.join(popular, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("met") / CHUNK)), F.lit(0)).alias("chunk"))
    sets = classes.select("rep", "shingles")
    left = numbered.select("a", "chunk").distinct().join(sets.withColumnRenamed("rep", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles")
    right = numbered.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "chunk", "b", "shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = None, None
        for x in batches:
            out = []
            for a, b, raw in zip(x["a"].tolist(), x["b"].tolist(), x["shingles"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    held, key = own, a
                elif key == a:
                    small, large = (own, held) if len(own) <= len(held) else (held, own)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        out.append((a, int(b)))
                else:
                    raise ValueError("a pair came before its set")
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = left.unionByName(right).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.select("a", F.col("b").cast("string"), "shingles").mapInPandas(run, "a long, b long")


def tiles(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, i, j, rep, component, own): the rows of all tiles, in which classes of different components meet.

    A bucket's heaviest component of two or more is set apart. All its members from buckets that hold others, too, are
    dealt into tiles once, for all their buckets; an outsider goes to the tiles of members that it shares a bucket
    with. A bucket's other members meet each other in a triangle of tiles. ``own`` tells the two sides of a tile apart.
    """
    labels = labels.toDF("rep", "component")
    known = cut(buckets.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"), (1 + F.floor(F.col("n") / HEAVY)).alias("w")), "known")
    parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    mixed = parts.groupBy("key").agg(F.max(F.when(F.col("n") > 1, F.struct("w", "component"))).alias("top"), F.count(F.lit(1)).alias("components"), F.sum("w").alias("all")).filter("components > 1")
    # Written, so that a bucket with very many members is no group of one task in the joins by key.
    mixed = cut(mixed.select("key", F.col("top.component").alias("major"), (F.col("all") - F.coalesce("top.w", F.lit(0))).alias("others")), "mixed")
    met = cut(known.join(mixed, "key"), "met")
    number = lambda w: F.ceil(F.col(w) / TILE).cast("int")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")

    within = met.filter("component = major").select("key", "major", "rep", "w")
    others = met.filter("major is null or component <> major")
    outside = others.filter("major is not null").select("key", "major", "rep", "component", "w")
    sized = lambda x, name: x.select("major", "rep", "w").distinct().groupBy("major").agg(F.sum("w").alias(name))
    sizes = cut(sized(within, "inner").join(sized(outside, "outer"), "major"), "sizes")
    within = within.join(sizes, "major").select("key", "major", "rep", place(number("inner")).alias("i"))
    outside = outside.join(sizes, "major").select("key", "major", "rep", "component", place(number("outer")).alias("j"))
    sent = cut(outside.join(within.select("key", "major", "i").distinct(), ["key", "major"]).select("major", "i", "j", "rep", "component").distinct(), "outsiders")
    inner = within.select("major", "i", "rep").distinct().join(sent.select("major", "i", "j").distinct(), ["major", "i"])
    inner = inner.select(F.col("major").alias("key"), "i", "j", "rep", F.col("major").alias("component"), F.lit(-1).alias("own"))
    outer = sent.select(F.col("major").alias("key"), "i", "j", "rep", "component", F.lit(-2).alias("own"))

    among = others.filter(F.col("others") > F.col("w")).select("key", "rep", "component", place(number("others")).alias("own"), F.explode(F.sequence(F.lit(0), number("others") - 1)).alias("other"))
    among = among.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component", "own")
    return inner.unionByName(outer).unionByName(among)


def as_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames of whole tiles, and where the tiles of a frame begin."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        starts = beginnings(x)
        rest = x.iloc[starts[-1] :]
        if len(starts) > 1:
            yield x.iloc[: starts[-1]], starts[:-1]
    if rest is not None and len(rest):
        yield rest, np.array([0])


def beginnings(x: pd.DataFrame) -> np.ndarray:
    keys = x[["key", "i", "j", "side"]].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))


def all_pairs(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q), p < q, of rows in one tile, about PAIRS at once; tiles of one size are done together."""
    sizes = np.diff(np.append(starts, rows))
    for size in np.unique(sizes).tolist():
        own = starts[sizes == size]
        if size * size > PAIRS:
            for begin in own.tolist():
                step = max(1, PAIRS // size)
                for lo in range(0, size, step):
                    p, q = np.nonzero(np.arange(size) > np.arange(lo, min(size, lo + step))[:, None])
                    yield p + begin + lo, q + begin
            continue
        p, q = np.triu_indices(size, 1)
        step = max(1, PAIRS // (size * size))
        for at in range(0, len(own) if size > 1 else 0, step):
            part = own[at : at + step, None]
            yield (part + p).ravel(), (part + q).ravel()


def survivors(x: pd.DataFrame, starts: np.ndarray, needed: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile, of its two sides and of different components, that sizes and the sequential test
    leave; in order."""
    sig, n, comp, own = as_rows(x["signature"]), x["n_shingles"].to_numpy(), x["component"].to_numpy(), x["own"].to_numpy()
    cross = (x["i"].to_numpy() != x["j"].to_numpy()) | (own < 0)
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in all_pairs(starts, len(x)):
        ok = (comp[p] != comp[q]) & (np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q])) & (~cross[p] | (own[p] != own[q]))
        p, q = p[ok], q[ok]
        left = may_reach(sig, sig, needed, p, q)
        ps.append(p[left])
        qs.append(q[left])
    p, q = np.concatenate(ps), np.concatenate(qs)
    order = np.argsort(p, kind="stable")
    return p[order], q[order]


def common(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (p, q) of sets: by looking up, or for many pairs by products of incidence
    matrices, over some thousand elements at once."""
    if len(p) <= 4 * len(sets):
        out = np.zeros(len(p), np.int64)
        for k, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
            small, large = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            out[k] = np.count_nonzero(large[at] == small)
        return out
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[which]  # an element of one set alone is in no intersection
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts, wide = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        begin, end = np.searchsorted(column, (lo, lo + wide))
        block = np.zeros((len(sets), wide), np.float32)
        block[row[begin:end], column[begin:end] - lo] = 1
        counts += block @ block.T
    return counts[p, q].astype(np.int64)


def forest(p: np.ndarray, q: np.ndarray, labels: np.ndarray) -> list[int]:
    """Numbers of the links (p, q) that join components which no link before them has joined."""
    _, at = np.unique(labels, return_inverse=True)
    root = list(range(len(labels)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (a, b) in enumerate(zip(at[p].tolist(), at[q].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            out.append(k)
    return out


def tile_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links between components, enough to join all that a confirmed pair in a bucket joins."""
    threshold, needed = percent / 100, least_matches(percent / 100)
    rows = cut(tiles(buckets, labels), "tiles")
    deal = lambda df: df.repartition("key", "i", "j", "side").sortWithinPartitions("key", "i", "j", "side")
    # A component and a bucket may have the same number.
    rows = rows.withColumn("side", F.when(F.col("own") < 0, 1).otherwise(0))
    names = ["key", "i", "j", "side", "rep", "component", "own"]

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in as_tiles(batches):
            p, q = survivors(x, starts, needed, threshold)
            if len(p):
                yield x.iloc[np.union1d(p, q)][names]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in as_tiles(batches):
            p, q = survivors(x, starts, needed, threshold)
            raw, n, rep, comp = x["shingles"].to_numpy(), x["n_shingles"].to_numpy(), x["rep"].to_numpy(), x["component"].to_numpy()
            at, a, b = np.searchsorted(p, np.append(starts, len(x))), [], []
            for t in np.flatnonzero(np.diff(at)).tolist():
                begin, end = starts[t], starts[t + 1] if t + 1 < len(starts) else len(x)
                u, v = p[at[t] : at[t + 1]] - begin, q[at[t] : at[t + 1]] - begin
                size = n[begin:end]
                both = common([np.frombuffer(r, np.uint64) for r in raw[begin:end]], u, v)
                sure = 100 * both >= percent * (size[u] + size[v] - both)
                u, v = u[sure], v[sure]
                kept = forest(u, v, comp[begin:end])
                a.append(rep[u[kept] + begin])
                b.append(rep[v[kept] + begin])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    schema = "key long, i int, j int, side int, rep long, component long, own int"
    likely = cut(deal(rows.join(classes.select("rep", "n_shingles", "signature"), "rep")).mapInPandas(tested, schema), "likely")
    return deal(likely.join(classes, "rep")).mapInPandas(linked, "a long, b long").distinct()


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(key, rep, n, m) of the buckets with m > 1 members; ``n``: the size of the member's set."""
    counts = sets.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    counts = cut(counts, "bucket-sizes")
    sent = bit_filter(counts.select("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.stack(b["bands"].to_numpy()) if len(b) else np.empty((0, BANDS), np.int64)
            hit = flagged(sent.value, keys.ravel())
            yield pd.DataFrame({"key": keys.ravel()[hit], "rep": np.repeat(b["doc_id"].to_numpy(np.int64), BANDS)[hit], "n": np.repeat(b["n_shingles"].to_numpy(np.int64), BANDS)[hit]})

    return cut(sets.select("doc_id", "n_shingles", "bands").mapInPandas(run, "key long, rep long, n long").join(counts, "key"), "buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each bucket's members with the one that has most company over all its buckets, the likeliest centre of
    a group of copies that differ from each other more than from their origin."""
    company = buckets.groupBy("rep").agg(F.sum("m").alias("company"))
    centres = buckets.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("c"))).alias("top")).select("key", (-F.col("top.c")).alias("centre"))
    met = buckets.join(cut(centres, "centres"), "key").filter("rep <> centre")
    return met.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    threshold = percent / 100
    sets = cut(fingerprints(docs), "sets")
    full = sets.filter("c1 is not null and doc_id is not null")
    texts = docs
    if not sets.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        first = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        texts, full = first, cut(fingerprints(first), "sets").filter("c1 is not null and doc_id is not null")
    # Only sets that several have are joined; a hot one is split by the join, as its other side is a written table.
    several = cut(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "classes")
    member = full.join(several, ["c1", "c2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_shingles", "bands")
    buckets = shared_buckets(cut(member.filter("doc_id = rep").drop("rep"), "alone"))
    chosen = full_sets(texts, cut(buckets.select("rep").distinct(), "wanted"))
    near = cut(confirmed(cut(pruned(star_pairs(buckets), chosen, threshold), "pairs"), chosen, percent), "near")
    more = cut(tile_links(buckets, components(near), chosen, percent), "links")
    found = cut(components(near.unionByName(more)), "found")
    member = member.select("doc_id", "rep").join(found.toDF("rep", "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(member, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
