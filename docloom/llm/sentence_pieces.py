"""SentencePiece encoding and decoding over a relational lattice.

Normalised texts fall into units where no piece crosses: at the space mark, if the model allows it between letters and
other characters, and in long units between any two characters that no piece has side by side. Each distinct unit of some
blocks of documents is encoded once: its substrings of bounded length are exploded and equi-joined to the piece table,
the edges that remain are grouped by unit as they stream by, and a higher-order ``aggregate`` folds them into a
segmentation. The ids go back to the blocks, where they take the places of the units. Decoding joins the pieces of ids.

The fold follows the model. A unigram model takes the path of the highest score (Viterbi). A BPE model does not choose
by path score, so Viterbi would give other ids than the library: there the fold merges, step by step, the two neighbours
whose joint edge has the highest score, leftmost first. Characters without a piece become byte pieces.

A lattice is a band: for each start a value for each length up to the model's longest piece. A longer unit is folded in
windows: it is cut where no edge crosses, which changes nothing, and cuts are left out as long as a window is no longer
than a piece. A window that can't be cut is folded by rounds: all merges of one score that don't touch each other's
outcome are one step, which is checked, or else the leftmost is. So a unit of any length takes the same path to its ids.

Defined results: a null text is empty and has no pieces. Rows are documents of their own, whatever their doc_id, repeated
ones too. Other columns, whatever their names, don't matter and aren't returned. A very long text is held, with its units, in the task
that reads it. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import add_columns

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Runs of letters or of other characters, each with the marks before it; marks that end a text.
FINE = re.compile(f"{MARK}*[{LETTERS}]+|{MARK}*[^{MARK}{LETTERS}]+|{MARK}+")
#: The same without a cut between letters and others, for models that have pieces across.
COARSE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BLOCK = 10_000
UNITS = "unit string, ids array<int>, ok boolean"
#: Characters of a long unit that are exploded from one row.
STRETCH = 4096


@lru_cache(maxsize=2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def plain_ids(sp) -> list[int]:
    return [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


@lru_cache(maxsize=2)
def cutter(path: str) -> re.Pattern:
    """The finest pattern that no piece of the model crosses: units cut by it are independent of each other."""
    pieces = [model(path).id_to_piece(i) for i in plain_ids(model(path))]
    for pattern in (FINE, COARSE):
        if all(pattern.fullmatch(p) for p in pieces):
            return pattern
    raise ValueError("a piece crosses the space mark; units would not be independent")


@lru_cache(maxsize=2)
def neighbours(path: str) -> tuple[int, frozenset[str]]:
    """The length of the longest piece, and all pairs of characters that some piece has side by side."""
    pieces = [model(path).id_to_piece(i) for i in plain_ids(model(path))]
    return max(map(len, pieces)), frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))


def units(normal: str, path: str) -> list[str]:
    """The units of a normalised text, in order."""
    return finer(cutter(path).findall(normal), path)


def finer(coarse: list[str], path: str) -> list[str]:
    """``coarse`` with those units that are longer than a piece cut between characters that no piece has side by side."""
    longest, pairs = neighbours(path)
    fine = []
    for u in coarse:
        if len(u) > longest:
            ends = [k for k in range(1, len(u)) if u[k - 1 : k + 1] not in pairs]
            fine += [u[lo:hi] for lo, hi in zip([0, *ends], [*ends, len(u)], strict=True)]
        else:
            fine.append(u)
    return fine


class Numbers(dict):
    """Units and their numbers, in the order in which they are met. A new unit that is longer than a piece is a KeyError, as
    it may have to be cut; one that ``add`` took is known."""

    def __init__(self, longest: int):
        super().__init__()
        self.longest = longest

    def __missing__(self, unit: str) -> int:
        if len(unit) > self.longest:
            raise KeyError(unit)
        return self.add(unit)

    def add(self, unit: str) -> int:
        return self.setdefault(unit, len(self))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, bytes, plain): as many rows as the vocabulary has, which bounds what is broadcast."""
    sp = model(path)
    rows = [(p := sp.id_to_piece(i), i, p.encode().hex().upper(), True) for i in plain_ids(sp)]
    rows += [(p := sp.id_to_piece(i), i, p[3:5], False) for i in range(sp.get_piece_size()) if sp.is_byte(i)]
    return spark.createDataFrame(rows, "piece string, id int, bytes string, plain boolean")


@lru_cache(maxsize=2)
def scores(path: str) -> list[float]:
    """The scores that pieces have, highest first, each once."""
    return sorted({model(path).get_score(i) for i in plain_ids(model(path))}, reverse=True)


@lru_cache(maxsize=2)
def values_of(path: str) -> tuple[int, np.ndarray]:
    """The bits of an id, and the value of each id of so many bits: its rank, which is its score's place in ``scores``,
    above its id; -1 for what is no piece of text."""
    sp, ranks = model(path), {x: i for i, x in enumerate(scores(path))}
    id_bits = (sp.get_piece_size() - 1).bit_length()
    out = np.full(1 << id_bits, -1, np.int32 if 2 * id_bits <= 31 else np.int64)  # a rank has no more bits than an id
    for i in plain_ids(sp):
        out[i] = (ranks[sp.get_score(i)] << id_bits) + i
    return id_bits, out


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once: what a lambda uses twice would be worked out at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged(n: Column, values: Column, ranked: Callable[[Column], Column], width: int | None = None) -> Column:
    """Starts of the pieces, and the end, of a unit of n characters under a BPE model.

    ``values``: an unused one, then for each start a row of ends, n of them, or ``width`` where that is given. The fold
    carries the starts. A step looks up the joint edge of each two neighbours (null if there is none, as past the end)
    and merges where it ranks first, which is leftmost among equals. ``ranked``: from a value to its rank.
    """
    if width is None:
        edge = lambda lo, hi: ranked(F.get(values, lo * n + (hi - lo)))
    else:
        edge = lambda lo, hi: F.when(hi - lo <= width, ranked(F.get(values, lo * width + (hi - lo))))
    joints = lambda b: F.transform(b, lambda lo, i: edge(lo, F.get(b, i + 2)))
    leftmost = lambda b, joint, least: F.array_remove(b, F.get(b, F.array_position(joint, least).cast("int")))

    def step(b: Column, _: Column) -> Column:
        return F.coalesce(bound(joints(b), lambda v: leftmost(b, v, F.array_min(v))), b)

    def round_(state: Column, _: Column) -> Column:
        b, joint, least = state["b"], state["joint"], state["least"]
        # Places of the best joints; of those in a row, each with a character of the one before, every other one.
        best = F.filter(F.transform(joint, lambda v, i: F.when(v == least, i)), lambda i: i.isNotNull())
        runs = lambda at: F.transform(at, lambda h, k: h - k)
        apart = lambda at: bound(runs(at), lambda g: F.filter(at, lambda h, k: (k - F.array_position(g, h - k) + 1) % 2 == 0))
        # A merge whose piece could join the next one's first half first decides before that does.
        touches = lambda at: F.exists(F.transform(at, lambda h, k: (F.get(at, k + 1) == h + 2) & (F.coalesce(edge(F.get(b, h), F.get(b, h + 3)) <= least, F.lit(False)))), lambda x: x)
        as_state = lambda nb: bound(joints(nb), lambda v: F.struct(nb.alias("b"), v.alias("joint"), F.array_min(v).alias("least")))
        one = lambda: bound(leftmost(b, joint, least), as_state)
        many = lambda at: bound(F.array_except(b, F.transform(at, lambda h: F.get(b, h + 1))), as_state)
        safe = lambda at: F.when((F.size(at) < 2) | touches(at), one()).otherwise(bound(many(at), lambda x: F.when(x["least"] <= least, one()).otherwise(x)))
        return F.when(least.isNull(), state).otherwise(bound(bound(best, apart), safe))

    begin, steps = F.sequence(F.lit(0), n), F.sequence(F.lit(2), F.greatest(n, F.lit(2)))
    if width is None:
        return F.aggregate(steps, begin, step)
    first = bound(begin, lambda b: bound(joints(b), lambda v: F.struct(b.alias("b"), v.alias("joint"), F.array_min(v).alias("least"))))
    return F.aggregate(steps, first, round_, lambda x: x["b"])


def viterbi(n: Column, width: Column, scores: Column, missing: float = -1e6) -> Column:
    """The same for a unigram model, places from 1 and ``scores`` without the unused value: the path of the highest total
    score; a character without a piece costs most."""
    empty = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("from")))

    def step(best: Column, end: Column) -> Column:
        score = lambda start: F.coalesce(F.get(scores, (start - 1) * width + end - start), F.when(start == end, F.lit(missing)).otherwise(F.lit(-1e12)))
        ways = F.transform(F.sequence(F.greatest(F.lit(1), end - width + 1), end), lambda start: F.struct((F.get(best, start - 1)["s"] + score(start)).alias("s"), start.alias("from")))
        return F.concat(best, F.array(F.array_max(ways)))

    table = F.aggregate(F.sequence(F.lit(1), n), empty, step)
    back = lambda t: F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), lambda b, _: F.when(F.get(b, F.lit(0)) > 1, F.concat(F.array(F.get(t, F.get(b, F.lit(0)) - 1)["from"]), b)).otherwise(b))
    return bound(table, back)


def windows(n: int, starts: np.ndarray, lengths: np.ndarray, width: int) -> list[int]:
    """Where to cut a unit of ``n`` characters with these edges: where none crosses, into windows of at most ``width``
    characters unless one can't be cut. From 0 to n."""
    crossed = np.zeros(n + 1, np.int32)
    np.add.at(crossed, starts + 1, lengths > 1)
    np.add.at(crossed, starts + lengths, -(lengths > 1).astype(np.int32))
    free, out = np.flatnonzero(np.cumsum(crossed) == 0), [0]
    while out[-1] < n:
        k = int(np.searchsorted(free, out[-1] + width, side="right")) - 1
        out.append(int(free[k] if free[k] > out[-1] else free[k + 1]))
    return out


def lattices(spans: DataFrame, carried: list[str], width: int, path: str) -> DataFrame:
    """(unit, n, values, more): the lattice of each unit of n characters, as ``merged`` reads it; null: no piece. A unit
    of more than ``width`` characters comes in windows; ``more``: another one follows.

    A unit's rows lie next to each other, as exploding and joining a broadcast table keep them; so they are grouped as
    they stream by, with no shuffle, sort or hash table. Rows in another order are an error, not a wrong lattice.

    ``spans``: at, the number of the unit's row; edge, below 0 in a unit's first row, -1 - n there, else its place with
    its id in the lowest bits; unit and ``carried``, columns of a unit's first row that pass through with its first window.
    Few columns, as Spark measures each of them for every row that it hands over.
    """
    of = values_of(path)[1].dtype.type
    names = ["unit", "n", "values", "more", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], -1

        def short(t: pa.Table, own: np.ndarray, ends: np.ndarray, n: np.ndarray, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            """Units that are no longer than a piece, all at once; their rows lie from ``own`` to ``ends``."""
            lo, hi = own[0], ends[-1]
            size = n**2 + 1
            begin = np.cumsum(size) - size
            edge = place[lo:hi] >= 0
            where = (np.repeat(begin, ends - own) + place[lo:hi])[edge]
            values = np.full(int(size.sum()), -1, of)
            values[where] = value[lo:hi][edge]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), pa.array(values, mask=values < 0))
            first = pa.array(own)
            unit, *kept = [t.column(c).take(first).combine_chunks() for c in ("unit", *carried)]
            return pa.RecordBatch.from_arrays([unit, pa.array(n.astype(np.int32)), lists, pa.array(np.zeros(len(own), bool)), *kept], names=names)

        def long(t: pa.Table, lo: int, hi: int, n: int, place: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            unit, at = t.column("unit")[lo].as_py(), place[lo:hi] - 1
            edge = at >= 0
            starts, lengths = at[edge] // width, at[edge] % width + 1
            band = np.full((n, width), -1, of)
            band[starts, lengths - 1] = value[lo:hi][edge]
            cuts = windows(n, starts, lengths, width)
            none = [pa.nulls(1, t.schema.field(c).type) for c in carried]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                own = band[a:b, : min(width, b - a)].ravel()
                values = np.append(of(-1), own)
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=values < 0))
                kept = none if k else [t.column(c).slice(lo, 1).combine_chunks() for c in carried]
                yield pa.RecordBatch.from_arrays([pa.array([unit[a:b]]), pa.array([b - a], pa.int32()), lists, pa.array([b < n]), *kept], names=names)

        def made(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            (id_bits, value_of), edge = values_of(path), t.column("edge").to_numpy()
            n, place, value = -1 - edge[starts], edge >> id_bits, value_of[edge & (len(value_of) - 1)]
            ends = np.append(starts[1:], len(t))
            many = n > width
            # Cut at long units and every 2000 rows.
            groups = np.split(np.arange(len(starts)), np.unique(np.concatenate([np.flatnonzero(many), np.flatnonzero(many) + 1, np.arange(0, len(starts), 2000)])))
            for g in groups:
                if not len(g):
                    continue
                if many[g[0]]:
                    yield from long(t, starts[g[0]], ends[g[0]], int(n[g[0]]), place, value)
                else:
                    yield short(t, starts[g], ends[g], n[g], place, value)

        def whole(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
            return t.combine_chunks(), np.flatnonzero(t.column("edge").to_numpy() < 0)

        for b in batches:
            if not b.num_rows:
                continue
            order, heads = b.column("at").to_numpy(), np.flatnonzero(b.column("edge").to_numpy() < 0)
            if order[0] < last or (np.diff(order) < 0).any() or (order[0] > last) + np.count_nonzero(np.diff(order)) != len(heads):
                raise RuntimeError("the edges of a unit do not lie together")
            last = order[-1]
            if len(heads) and rest and heads[0] > 0:
                rest.append(b.slice(0, heads[0]))
            elif not len(heads):
                rest.append(b)
                continue
            if len(heads) > 1 or rest:
                if rest:
                    yield from made(*whole(pa.Table.from_batches(rest)))
                if len(heads) > 1:
                    yield from made(*whole(pa.Table.from_batches([b.slice(heads[0], heads[-1] - heads[0])])))
            rest = [b.slice(heads[-1])]
        if rest:
            yield from made(*whole(pa.Table.from_batches(rest)))

    kind = T.IntegerType() if of == np.int32 else T.LongType()
    return spans.mapInArrow(run, T.StructType([*[T.StructField(c, t) for c, t in (("unit", T.StringType()), ("n", T.IntegerType()), ("values", T.ArrayType(kind)), ("more", T.BooleanType()))], *[spans.schema[c] for c in carried]]))


def folded_units(rows: DataFrame, path: str, unigram: bool = False) -> DataFrame:
    """``rows`` in their order, with the ids of their unit; null where there is none. A long unit comes in windows:
    rows that lie next to each other, of which all but the last have ``more``, and the first has the other columns.

    ``rows``: unit and columns that pass through.
    """
    spark, sp = rows.sparkSession, model(path)
    carried = [c for c in rows.columns if c != "unit"]
    longest, id_bits = neighbours(path)[0], values_of(path)[0]
    # The join is on a fingerprint, as long keys are looked up faster; the pieces themselves are compared after it.
    plain = F.broadcast(piece_table(spark, path).filter("plain").select(F.xxhash64("piece").alias("key"), "piece", "id"))
    # Each row starts with a row of its own (s = 0), which has no place and carries the columns. Rows without a unit have
    # no other. Stretches of a unit, from 0 on, are cut out first, so that its characters are not counted for each start.
    numbered = rows.select(F.monotonically_increasing_id().alias("at"), "unit", F.coalesce(F.length("unit"), F.lit(0)).alias("n"), *carried)
    cut_out = numbered.select("at", "unit", "n", *carried, F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / STRETCH).cast("int"))).alias("c"))
    once = [F.when(F.col("c") == 0, F.col(x)).alias(x) for x in ("unit", *carried)]
    cut_out = cut_out.select("at", "n", "c", *once, F.when(F.col("n") <= STRETCH, F.col("unit")).otherwise(F.substring("unit", F.col("c") * STRETCH + 1, F.lit(STRETCH + longest - 1))).alias("stretch"))
    first = F.when(F.col("c") == 0, 0).otherwise(1)
    starts = cut_out.filter("c = 0 or n > 0").select("at", "n", "c", "stretch", "unit", *carried, F.explode(F.sequence(first, F.least(F.col("n") - F.col("c") * STRETCH, F.lit(STRETCH)))).alias("s"))
    once = [F.when(F.col("s") == 0, F.col(x)).alias(x) for x in ("unit", *carried)]
    starts = starts.select("at", "n", F.when(F.col("s") > 0, F.col("c") * STRETCH + F.col("s")).otherwise(0).alias("s"), *once, F.expr(f"if(s = 0, null, substring(stretch, s, {longest}))").alias("head"))
    spans = starts.select("at", "n", "s", "unit", *carried, "head", F.explode(F.when(F.col("s") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("head")))).alias("l"))
    parts = spans.withColumn("part", F.expr("if(s = 0, null, substring(head, 1, l))")).withColumn("key", F.expr("if(s = 0, null, xxhash64(part))"))
    edges = parts.join(plain, "key", "left").filter("s = 0 or piece = part")
    edge = F.expr(f"if(s = 0, -1L - n, ((s - 1L) * least(n, {longest}) + l) * {1 << id_bits} + id)")
    lattice = lattices(edges.select("at", edge.alias("edge"), "unit", *carried), carried, longest, path)
    n, values = F.col("n"), F.col("values")
    # Values order pieces as their ranks do, unless two share one.
    own_ranks = len(scores(path)) == len(plain_ids(sp))
    ranked = lambda v: v if own_ranks else F.shiftright(v, id_bits)
    width = F.least(n, F.lit(longest))
    if unigram:
        levels = F.lit(scores(path))
        lattice = lattice.withColumn("scores", F.transform(F.slice("values", F.lit(2), n * width), lambda v: F.get(levels, F.shiftright(v, id_bits).cast("int"))))
        way = F.transform(viterbi(n, width, F.col("scores")), lambda x: x - 1)
    else:
        way = F.when(n <= longest, merged(n, values, ranked)).otherwise(merged(n, values, ranked, longest))
    cuts = lattice.withColumn("b", F.when(n > 0, way))
    first_byte = sp.piece_to_id("<0x00>")
    as_bytes = lambda ch: F.transform(F.sequence(F.lit(1), F.octet_length(ch)), lambda k: F.conv(F.substring(F.hex(F.encode(ch, "UTF-8")), 2 * k - 1, F.lit(2)), 16, 10).cast("int") + first_byte)

    def ids_of(i: Column) -> Column:
        lo, hi = F.get("b", i), F.get("b", i + 1)
        known = F.get(values, lo * width + (hi - lo)).bitwiseAND(2**id_bits - 1).cast("int")
        return F.when(known.isNotNull(), F.array(known)).otherwise(as_bytes(F.substring(F.col("unit"), lo + 1, hi - lo)))

    return cuts.select("unit", *carried, F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size("b") - 2), ids_of))).alias("ids"), "more")


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``folded_units`` with the windows of a unit joined: its text, its ids, the columns of its first row."""
    held: list[pa.RecordBatch] = []

    def joined(rows: pa.Table) -> pa.Table:
        more = rows.column("more").to_numpy()
        heads = np.flatnonzero(~np.append(False, more[:-1]))
        ends = np.append(heads[1:], len(rows))
        unit, ids = rows.column("unit"), rows.column("ids")
        text = ["".join(unit[lo:hi].to_pylist()) if hi - lo > 1 else unit[lo].as_py() for lo, hi in zip(heads, ends, strict=True)]
        lists = [[x for own in ids[lo:hi].to_pylist() for x in own] if hi - lo > 1 else ids[lo].as_py() for lo, hi in zip(heads, ends, strict=True)]
        out = rows.take(pa.array(heads))
        out = out.set_column(out.schema.get_field_index("unit"), "unit", pa.array(text, pa.string()))
        return out.set_column(out.schema.get_field_index("ids"), "ids", pa.array(lists, ids.type))

    for b in batches:
        if not b.num_rows:
            continue
        more = b.column("more").to_numpy(zero_copy_only=False)
        if not held and not more.any():
            yield b
            continue
        held.append(b)
        if not more[-1]:
            yield joined(pa.Table.from_batches(held)).combine_chunks().to_batches()[0]
            held = []
    if held:
        raise RuntimeError("the last window of a unit is missing")


def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    own = model(path)
    return [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).encode() for i in range(own.get_piece_size())]


def encode_units(distinct: DataFrame, path: str, unigram: bool = False) -> DataFrame:
    """(unit, ids, ok) for distinct units; ``ok``: the ids decode to the unit."""

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = piece_bytes(path)
        for b in whole_units(batches):
            ok = [b"".join([raw[i] for i in ids]) == u.encode() for u, ids in zip(b.column("unit").to_pylist(), b.column("ids").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("ids"), pa.array(ok, pa.bool_())], names=["unit", "ids", "ok"])

    return folded_units(distinct.select("unit"), path, unigram).mapInArrow(finished, UNITS)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes, compressed: one each for those below 255, then what the others have beyond in bytes of
    their own, the lower ones first. Most numbers are small where they are places in an order by frequency."""
    more = values[values >= 255] - 255
    high = more >> 8
    rest = high[high >= 255] - 255
    planes = [np.minimum(values, 255).astype(np.uint8), (more & 255).astype(np.uint8), np.minimum(high, 255).astype(np.uint8), rest.astype("<i4")]
    sizes = np.array([len(values), len(more), len(rest)], "<i4").tobytes()
    return sizes + (pa.Codec("zstd", 3).compress(b"".join(x.tobytes() for x in planes), asbytes=True) if len(values) else b"")


def unsqueezed(raw: bytes) -> np.ndarray:
    n, m, k = np.frombuffer(raw[:12], "<i4").tolist()
    if not n:
        return np.zeros(0, np.int32)
    planes = pa.decompress(raw[12:], n + 2 * m + 4 * k, codec="zstd", asbytes=True)
    out, low, high = (np.frombuffer(planes[lo:hi], np.uint8).astype(np.int32) for lo, hi in ((0, n), (n, n + m), (n + m, n + 2 * m)))
    high[high == 255] += np.frombuffer(planes[n + 2 * m :], "<i4")
    out[out == 255] += low + (high << 8)
    return out


def picked(flat: np.ndarray, starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``flat`` from each start on, as many values as are asked for, one after the other."""
    ends = np.cumsum(many)
    return flat[np.repeat(starts - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]


def spoken(normal: str) -> str:
    """A normalised text as it is decoded: marks as spaces, the first one dropped."""
    return normal.replace(MARK, " ").removeprefix(" ")


#: Documents whose units travel in one row; rows of ids that a task gathers before it deals them by block.
CHUNK, GATHERED = 1000, 300_000
#: Buckets of units at least and at most, in between one for BUCKET_DOCS documents: a task holds one of them at a time.
BUCKETS, MOST_BUCKETS, BUCKET_DOCS = 1024, 1 << 18, 2500
#: A unit's place: its block and its number there. Before documents it is their block and the size of their head.
REF = np.dtype([("block", "<i8"), ("number", "<i4")])


def encode(docs: DataFrame, path: str, unigram: bool = False) -> DataFrame:
    """(row, doc_id, ids) for every row of ``docs``: all ids in order. ``row`` tells apart rows with one doc_id."""

    def start():
        return lambda head, flat, ends: [head.column("row"), head.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))]

    return encoded_as(docs, path, [T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))], start, unigram)


def encoded_as(docs: DataFrame, path: str, fields: list[T.StructField], start: Callable, unigram: bool = False) -> DataFrame:
    """The columns ``fields`` for every row of ``docs``, made from its ids where they are put in order.

    ``start`` runs once per task and returns the function that makes them, for some documents, from their row, doc_id and
    normal_md5 (the digest of the normalised text as it should be decoded), all their ids, and where those of each end.

    A block of documents numbers its units; its documents become lists of numbers. Its units travel by hash, those of one
    bucket in one row. There each distinct unit is encoded once, and its ids go back to all its blocks, where
    the numbers are replaced by them. So a unit counts at most once a block, however often it occurs, and no row per
    occurrence is ever dealt out.
    """
    buckets = max(BUCKETS, min(MOST_BUCKETS, docs.count() // BUCKET_DOCS))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int, bucket: list, words: list, heads: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(bucket, pa.int32()), pa.array(words, pa.binary()), pa.array(heads, pa.binary()), pa.array(data, pa.binary())], names=["block", "bucket", "words", "heads", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b, number, held = batch.slice(at, BLOCK), Numbers(neighbours(path)[0]), []
                block = b.column("row")[0].as_py()
                for lo in range(0, b.num_rows, CHUNK):
                    c, word, many, normal = b.slice(lo, CHUNK), array("i"), [], []
                    for text in c.column("text").to_pylist():
                        plain = model(path).normalize(text) if text else ""
                        own, before = cutter(path).findall(plain), len(word)
                        try:
                            word.extend(map(number.__getitem__, own))
                        except KeyError:
                            del word[before:]
                            own = finer(own, path)
                            word.extend(map(number.add, own))
                        many.append(len(own))
                        normal.append(hashlib.md5(spoken(plain).encode(), usedforsecurity=False).digest())
                    head = pa.RecordBatch.from_arrays([c.column("row"), c.column("doc_id"), pa.array(many, pa.int64()), pa.array(normal, pa.binary())], names=["row", "doc_id", "many", "normal_md5"])
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                        stream.write_batch(head)
                    held.append((lo, out.getvalue().to_pybytes(), np.array(word, np.int32)))
                # A unit's number is its place by frequency in the block.
                times = sum(np.bincount(word, minlength=len(number)) for _, _, word in held)
                by_times = np.argsort(-times, kind="stable")
                place = np.empty(len(number), np.int32)
                place[by_times] = np.arange(len(number))
                for lo, head, word in held:
                    yield rows(block, [zlib.crc32(b"%d" % (block + lo)) % buckets], [None], [head], [squeezed(place[word])])
                if not number:
                    continue
                words = [w.encode() for w in number]
                words = [words[i] for i in by_times.tolist()]
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
                order, size = np.argsort(bucket, kind="stable"), np.fromiter(map(len, words), np.int32, len(words))
                names, begin = np.unique(bucket[order], return_index=True)
                of_bucket = [order[lo:hi] for lo, hi in zip(begin, [*begin[1:], len(order)], strict=True)]
                texts = [b"".join([words[i] for i in own.tolist()]) for own in of_bucket]
                texts = [len(t).to_bytes(4, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in texts]
                yield rows(block, names.tolist(), texts, [None] * len(names), [squeezed(np.concatenate([np.diff(own, prepend=0), size[own]])) for own in of_bucket])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["unit", "load"]
        key, units_, blocks, numbers = None, [], [], []

        def made() -> Iterator[pa.RecordBatch]:
            met = pa.concat_arrays(units_).dictionary_encode()
            which = met.indices.to_numpy()
            order, ends, n = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which)), len(met.dictionary)
            refs = np.empty(len(order), REF)
            refs["block"], refs["number"] = (np.concatenate(x)[order] for x in (blocks, numbers))
            whole = pa.RecordBatch.from_arrays([met.dictionary, binaries(refs, ends)], names=names)
            for at in range(0, n, 4000):
                yield whole.slice(at, 4000)
            for x in (units_, blocks, numbers):
                x.clear()

        for b in batches:
            for block, bucket, words, heads, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("words"), b.column("heads"), b.column("data"), strict=True):
                if heads.is_valid:
                    head = heads.as_py()
                    load = np.array([(block, len(head))], REF).tobytes() + head + data.as_py()
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([load], pa.binary())], names=names)
                    continue
                if units_ and bucket != key:
                    yield from made()
                key, raw = bucket, words.as_py()
                number, size = unsqueezed(data.as_py()).reshape(2, -1)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                units_.append(pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True))))
                blocks.append(np.full(len(size), block, "<i8"))
                numbers.append(np.cumsum(number).astype("<i4"))
        if units_:
            yield from made()

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(blocks: list, heads: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(heads, pa.binary()), pa.array(data, pa.binary())], names=["block", "heads", "data"])

        def flushed() -> pa.RecordBatch:
            block, number, many, flat = map(np.concatenate, zip(*held, strict=True))
            order, starts = np.lexsort((number, block)), np.cumsum(many) - many
            names, begin = np.unique(block[order], return_index=True)
            data = []
            for lo, hi in zip(begin, [*begin[1:], len(order)], strict=True):
                own = order[lo:hi]
                data.append(squeezed(np.concatenate([[len(own)], np.diff(number[own], prepend=0), many[own], picked(flat, starts[own], many[own])])))
            held.clear()
            return out(names.tolist(), [None] * len(names), data)

        for b in whole_units(batches):
            own_row = pc.is_null(b.column("unit"))
            h, b = b.filter(own_row), b.filter(pc.invert(own_row))
            for i in range(len(h)):
                load = h.column("load")[i].as_py()
                block, size_of_head = np.frombuffer(load, REF, 1)[0].tolist()
                data = REF.itemsize + size_of_head
                yield out([block], [load[REF.itemsize : data]], [load[data:]])
            if not len(b):
                continue
            many, flat = pc.list_value_length(b.column("ids")).to_numpy(), b.column("ids").flatten().to_numpy()
            refs = np.frombuffer(b"".join(b.column("load").to_pylist()), REF)
            starts, which = np.cumsum(many) - many, np.repeat(np.arange(len(b)), pc.binary_length(b.column("load")).to_numpy() // REF.itemsize)
            held.append((refs["block"], refs["number"], many[which], picked(flat, starts[which], many[which])))
            size += len(refs)
            if size > GATHERED:
                yield flushed()
                size = 0
        if held:
            yield flushed()

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, key, known, table = start(), None, [], None
        for b in batches:
            for block, heads, data in zip(b.column("block").to_pylist(), b.column("heads"), b.column("data"), strict=True):
                if block != key:
                    key, known, table = block, [], None
                if not heads.is_valid:
                    known.append(unsqueezed(data.as_py()))
                    continue
                if table is None:
                    sizes = [x[0] for x in known]
                    number, many, flat = (np.concatenate([np.zeros(0, np.int32), *x]) for x in ([np.cumsum(x[1 : n + 1]) for x, n in zip(known, sizes, strict=True)], [x[n + 1 : 2 * n + 1] for x, n in zip(known, sizes, strict=True)], [x[2 * n + 1 :] for x, n in zip(known, sizes, strict=True)]))
                    if not np.array_equal(np.sort(number), np.arange(len(number))):
                        raise RuntimeError("a block did not get the ids of each of its units once")
                    starts, counts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                    starts[number], counts[number] = np.cumsum(many, dtype=np.int64) - many, many
                    known, table = [], (starts, counts, flat)
                starts, counts, flat = table
                word = unsqueezed(data.as_py())
                head = pa.ipc.open_stream(heads.as_py()).read_next_batch()
                ends = np.append(0, np.cumsum(counts[word]))[np.append(0, np.cumsum(head.column("many").to_numpy()))]
                yield pa.RecordBatch.from_arrays(of(head, picked(flat, starts[word], counts[word]), ends), names=[f.name for f in fields])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    posted = rows.mapInArrow(numbered, "block long, bucket int, words binary, heads binary, data binary")
    met = posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gathered, "unit string, load binary")
    back = folded_units(met, path, unigram).mapInArrow(returned, "block long, heads binary, data binary")
    by_block = back.repartition("block").sortWithinPartitions("block", F.col("heads").isNotNull())
    return by_block.mapInArrow(replaced, T.StructType(fields))


def decoder(path: str) -> Callable[[np.ndarray, np.ndarray], Iterator[str]]:
    """A function from ids, and where those of each document end, to the texts: the bytes of the pieces in order, marks as
    spaces, the first one dropped."""
    raw = piece_bytes(path)

    def of(flat: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield spoken(b"".join([raw[i] for i in flat[lo:hi].tolist()]).decode(errors="replace"))

    return of


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text of its ids."""

    def start():
        of = decoder(path)

        def texts(b: pa.RecordBatch) -> dict:
            many = pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy()
            return {"text": list(of(b.column("ids").flatten().to_numpy(), np.append(0, np.cumsum(many))))}

        return texts

    return add_columns(encoded, [("text", T.StringType())], start)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, id_sum, ids_crc32, text_sha256, round_trip) per row: the number and sum of the document's ids,
    the checksum of its ids in order (little-endian unsigned 32-bit), the digest of the text decoded from them, and
    whether that text is the normalised one. What encode() and decode() return, without moving it out of the task."""

    def start():
        decoded = decoder(path)

        def of(head: pa.RecordBatch, flat: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
            sums, own = np.append(0, np.cumsum(flat, dtype=np.int64))[ends], memoryview(flat.astype("<u4").tobytes())
            checks = [zlib.crc32(own[4 * lo : 4 * hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            same, digests = [], []
            for text, normal in zip(decoded(flat, ends), head.column("normal_md5").to_pylist(), strict=True):
                text = text.encode()
                same.append(hashlib.md5(text, usedforsecurity=False).digest() == normal)
                digests.append(hashlib.sha256(text).hexdigest())
            return [head.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(np.diff(sums)), pa.array(checks, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]

        return of

    kinds = {"n_pieces": T.LongType(), "id_sum": T.LongType(), "ids_crc32": T.LongType(), "text_sha256": T.StringType(), "round_trip": T.BooleanType()}
    return encoded_as(docs, path, [docs.schema["doc_id"], *[T.StructField(n, k) for n, k in kinds.items()]], start)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of the numbers up to each end."""
    offsets = (np.append(0, ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
