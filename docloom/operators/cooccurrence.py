"""An embedder learned from a table of texts: words that keep the same company get like vectors.

Word pairs within WINDOW words of each other are counted, a pair at distance d as 1 / d, per task before they move.
Their positive pointwise mutual information makes a sparse symmetric matrix M, a table (i, j, v) that never leaves Spark and
is packed into tiles of BLOCK by BLOCK words. It
is reduced by a randomised factorisation: M times a random matrix, whose rows are drawn from the word's number where they
are needed; a few rounds of orthonormalising and multiplying by M again, each a join of tiles with blocks of BLOCK rows and a
sum per block; and an eigenvalue problem of the size of the wanted dimension. Only matrices of that size, squared, come to the driver. A word's vector is its row of
the eigenvectors, by the square roots of the eigenvalues.

A text's vector is the sum of its words' vectors, weighted by a / (a + share) so that common words count little, and has
length 1. The vocabulary are the ``most`` frequent words of at least ``least`` occurrences: that bounds what an embedder sends
to tasks. Fitting the same table again gives the same vectors, up to the order in which sums are added.

Defined results: a null text has no words; repeated rows count each. A text without a known word has the zero vector, as has
every text after an empty table. Words are runs of letters and digits, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import store
from docloom.storage import cut

WINDOW, ROUNDS, SPARE = 5, 3, 16
LEAST, MOST = 5, 100_000
#: Words whose pairs a task counts at once; the weight of a common word.
HELD, COMMON = 1 << 20, 1e-3
#: Rows and columns of a tile; its entries that are multiplied at once.
BLOCK, ENTRIES = 2048, 1 << 15
WORD = r"[\p{L}\p{N}]+"
PLAIN = re.compile(r"[^\W_]+")


def words_of(texts: DataFrame, text: str) -> DataFrame:
    return texts.select(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))


def vocabulary(words: DataFrame, least: int, most: int) -> DataFrame:
    """(word, n, i): the most frequent words, numbered from the most frequent one on."""
    counts = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return store.numbered(counts, [F.desc("n"), "word"], "i").filter(F.col("i") < most)


def pairs(words: DataFrame, number: dict[str, int], window: int) -> DataFrame:
    """(i, j, n) of ordered pairs of known words; unknown ones keep their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("w")
            coded = lists.flatten().dictionary_encode()
            known = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            lengths = np.diff(lists.offsets.to_numpy())
            ids = np.full(int(lengths.sum()) + window * len(lengths), -1, np.int64)
            if len(coded):
                ids[np.arange(len(coded)) + window * np.repeat(np.arange(len(lengths)), lengths)] = known[coded.indices.to_numpy()]
            for lo in range(0, len(ids), HELD):
                keys, weights = [], []
                for d in range(1, window + 1):
                    c = ids[lo + d : lo + d + HELD]
                    a = ids[lo : lo + len(c)]
                    both = (a >= 0) & (c >= 0)
                    a, c = a[both], c[both]
                    keys.append((np.minimum(a, c) << 32) | np.maximum(a, c))
                    weights.append(np.full(len(a), 1 / d))
                key, which = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(which.ravel(), np.concatenate(weights), len(key)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["i", "j", "n"])

    # Each pair moves once, its smaller number first; a word with itself counts both ways.
    half = words.mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    return half.select(F.inline(ways))


def information(counts: DataFrame) -> DataFrame:
    """(i, j, v): the positive pointwise mutual information of symmetric counts."""
    sums = counts.groupBy("i").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    # A row per word of the vocabulary, which is bounded.
    rows = counts.join(F.broadcast(sums.withColumnRenamed("s", "si")), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("s").alias("sj"))), "j").join(F.broadcast(total))  # one row
    return rows.withColumn("v", F.log(F.col("n") * F.col("t") / (F.col("si") * F.col("sj")))).filter("v > 0").select("i", "j", "v")


def drawn(j: np.ndarray, width: int) -> np.ndarray:
    """Rows of the random matrix: signs from a hash of row and column."""
    with np.errstate(over="ignore"):
        x = (j.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(x >> np.uint64(63) > 0, 1.0, -1.0)


def summed(parts: DataFrame, width: int) -> DataFrame:
    """(i, x): the sums of the vectors of each i, added in tasks before and after they move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, at = np.unique(b["i"].to_numpy(), return_inverse=True)
            out = np.zeros((len(i), width))
            np.add.at(out, at.ravel(), np.stack(b["x"].to_numpy()) * (b["v"].to_numpy()[:, None] if "v" in b else 1.0))
            yield pd.DataFrame({"i": i, "x": list(out)})

    schema = "i long, x array<double>"
    dealt = parts.mapInPandas(run, schema).repartition("i").sortWithinPartitions("i")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in run(batches):
            if held is not None and len(b):
                if b["i"].iloc[0] == held["i"].iloc[0]:
                    b.at[0, "x"] = b["x"].iloc[0] + held["x"].iloc[0]
                else:
                    yield held
            if len(b):
                yield b.iloc[:-1]
                held = b.iloc[-1:].reset_index(drop=True)
        if held is not None:
            yield held

    return dealt.mapInPandas(last, schema)


def tiled(matrix: DataFrame) -> DataFrame:
    """(block, of, i, j, v): a matrix (i, j, v) in tiles, each of a block of rows and one of columns, in order of i."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = ((pdf["i"] % BLOCK) * BLOCK + pdf["j"] % BLOCK).to_numpy(np.uint32)
        order = np.argsort(at)
        i, j = np.divmod(at[order], np.uint32(BLOCK))
        return pd.DataFrame([(*key, i.astype("<u2").tobytes(), j.astype("<u2").tobytes(), pdf["v"].to_numpy("<f8")[order].tobytes())], columns=["block", "of", "i", "j", "v"])

    at = matrix.select(F.expr(f"i div {BLOCK}").alias("block"), F.expr(f"j div {BLOCK}").alias("of"), "i", "j", "v")
    # More parts than cores, so that no task has most of the full tiles, those of common words.
    dealt = at.repartition(4 * matrix.sparkSession.sparkContext.defaultParallelism, "block", "of")
    return dealt.groupBy("block", "of").applyInPandas(run, "block long, of long, i binary, j binary, v binary")


def multiplied(tiles: DataFrame, y: DataFrame | None, width: int) -> DataFrame:
    """(i, x): the product, in blocks, of the tiles of a matrix and the blocks ``y`` (i, x), or the random matrix. A block of
    rows is one array, BLOCK times ``width``."""
    random = y is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                i, j, v = np.frombuffer(r.i, "<u2"), np.frombuffer(r.j, "<u2"), np.frombuffer(r.v, "<f8")
                x = drawn(r.of * BLOCK + np.arange(BLOCK), width) if random else np.asarray(r.x).reshape(BLOCK, width)
                out = held.setdefault(r.block, np.zeros((BLOCK, width)))
                for lo in range(0, len(i), ENTRIES):
                    own = i[lo : lo + ENTRIES]
                    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    out[own[start]] += np.add.reduceat(x[j[lo : lo + ENTRIES]] * v[lo : lo + ENTRIES, None], start)
        for block, out in held.items():
            yield pd.DataFrame({"i": [block], "x": [out.ravel()]})

    met = tiles if random else tiles.join(y.select(F.col("i").alias("of"), "x"), "of")
    return summed(met.mapInPandas(run, "i long, x array<double>"), BLOCK * width)


def gram(y: DataFrame, width: int, z: DataFrame | None = None) -> np.ndarray:
    """The columns of blocks y by their columns, or by those of z."""
    itself = z is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            for r in b.itertuples(index=False):
                x = np.asarray(r.x).reshape(-1, width)
                total += x.T @ (x if itself else np.asarray(r.z).reshape(-1, width))
        yield pd.DataFrame({"x": [total.ravel()]})

    both = y if itself else y.join(z.select("i", F.col("x").alias("z")), "i")
    return sum((np.array(r["x"]).reshape(width, width) for r in both.mapInPandas(run, "x array<double>").toLocalIterator()), np.zeros((width, width)))


def turned(y: DataFrame, by: np.ndarray) -> DataFrame:
    """Each row of blocks times a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"i": [r.i], "x": [(np.asarray(r.x).reshape(-1, len(by)) @ by).ravel()]})

    return y.mapInPandas(run, "i long, x array<double>")


def rows_of(y: DataFrame, width: int) -> DataFrame:
    """(i, x): the rows of blocks; those of numbers that the matrix doesn't have are zero and left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = np.asarray(r.x).reshape(-1, width)
                have = np.flatnonzero(x.any(axis=1))
                yield pd.DataFrame({"i": r.i * BLOCK + have, "x": list(x[have])})

    return y.mapInPandas(run, "i long, x array<double>")


def inverse_root(g: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; directions of no weight are left out."""
    values, vectors = np.linalg.eigh(g)
    keep = values > max(values.max(), 0) * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def factorised(matrix: DataFrame, dim: int, rounds: int = ROUNDS) -> DataFrame:
    """(i, x): rows of the leading eigenvectors of a symmetric matrix (i, j, v), by the roots of their values' sizes."""
    width = dim + SPARE
    tiles = cut(tiled(matrix), "tiles")
    y = cut(multiplied(tiles, None, width), "range")
    for _ in range(rounds):
        root = inverse_root(gram(y, width))
        if not root.shape[1]:
            break
        width = root.shape[1]
        q = cut(turned(y, root), "basis")
        y = cut(multiplied(tiles, q, width), "range")
    if not width or y.isEmpty():
        return y
    # q's rows by y's: the matrix in the basis, whose eigenvectors turn the basis into the matrix's own.
    values, vectors = np.linalg.eigh(gram(q, width, y))
    best = np.argsort(-np.abs(values))[:dim]
    return rows_of(turned(q, vectors[:, best] * np.sqrt(np.abs(values[best]))), len(best))


def fit(texts: DataFrame, text: str = "text", dim: int = 64, window: int = WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, share, vector) of the vocabulary of ``texts``."""
    words = words_of(texts, text)
    known = cut(vocabulary(words, least, most), "vocabulary")
    number = {r["word"]: r["i"] for r in known.select("word", "i").toLocalIterator()}
    matrix = information(cut(pairs(words, number, window), "pairs"))
    total = known.agg(F.sum("n").alias("t"))
    return factorised(matrix, dim).join(known, "i").join(F.broadcast(total)).select("word", (F.col("n") / F.col("t")).alias("share"), F.col("x").alias("vector"))  # one row


def embedder(learned: DataFrame, dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to vectors of length 1, as the chunkers and ``embedding.embed_texts`` take."""
    rows = learned.select("word", "share", "vector").toPandas()
    at = {w: i for i, w in enumerate(rows["word"])}
    weights = np.zeros((len(rows), dim), np.float32)
    for i, (share, v) in enumerate(zip(rows["share"], rows["vector"], strict=True)):
        weights[i, : len(v)] = np.asarray(v) * (COMMON / (COMMON + share))

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            own = [at[w] for w in PLAIN.findall(t.lower()) if w in at]
            for lo in range(0, len(own), 4096):
                out[k] += weights[own[lo : lo + 4096]].sum(axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return embed
