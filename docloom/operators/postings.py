"""A keyword index: which blocks of texts hold which trigrams, so that a ``LIKE`` reads few of them.

Texts are numbered in the order of their ids and kept in blocks of BLOCK_ROWS, sorted, in at most PARTS folders. Each block's
distinct trigrams of code points, lower case, become postings: a trigram's blocks as a first number and the steps to the
next ones, in as few bytes as the largest step takes; they are partitioned by a hash of the trigram, and sorted in files
whose statistics tell which trigrams they may hold. A search takes the trigrams of a keyword's parts between wildcards,
counts per block how many of them it has, reads the blocks that have all, and decides by the ``LIKE`` itself, so its rows are
those of ``search.keyword_hits``. Where a keyword has no part of three characters, all blocks are read.

A null text matches nothing and is not kept. Repeated ids and texts are rows of their own; rows without id are left out. An
empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search, store
from docloom.storage import table_exists

BLOCK_ROWS, PARTS, BUCKETS = 128, 1024, 64
#: Postings that a task sorts at once; candidate blocks that a filter names one by one.
HELD, NAMED = 1_000_000, 200
#: Between two texts of a block, where a trigram doesn't count.
END = 0x1FFFFF
TEXTS = "id long, content string, block long, part int"
POSTINGS = "gram long, first long, n int, steps binary, bucket int"


def grams_of(texts: list[str]) -> np.ndarray:
    """The distinct trigrams of some texts, as numbers."""
    codes = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), END) for t in texts])
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    whole = (codes[:-2] != END) & (codes[1:-1] != END) & (codes[2:] != END)
    return np.unique(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[whole])


def coded(grams: np.ndarray, blocks: np.ndarray) -> pd.DataFrame:
    """Postings of (trigram, block) pairs, a row per trigram."""
    return packed(grams, blocks).to_pandas()


def packed(grams: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
    """The same without an object of Python for a row."""
    order = np.lexsort((blocks, grams))
    grams, blocks = grams[order], blocks[order]
    at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    n = np.diff(np.append(at, len(grams)))
    steps = np.append(0, blocks[1:] - blocks[:-1])
    steps[at] = 0
    top = np.maximum.reduceat(steps, at)
    width = np.select([top <= np.iinfo(k).max for k in ("u1", "u2", "u4")], [1, 2, 4], 8)
    start = np.append(0, np.cumsum((n - 1) * width))
    # All rows' steps as one run of bytes, a column of bytes at a time.
    rest, of = np.delete(np.arange(len(grams)), at), np.repeat(width, n - 1)
    place = np.cumsum(of) - of
    data = np.zeros(start[-1], np.uint8)
    for k in range(int(width.max())):
        own = of > k
        data[place[own] + k] = (steps[rest[own]] >> (8 * k)) & 0xFF
    raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(start.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(grams[at]), pa.array(blocks[at]), pa.array(n.astype(np.int32)), raw], names=["gram", "first", "n", "steps"])


def decoded(first: int, n: int, steps: bytes) -> np.ndarray:
    if n == 1:
        return np.array([first])
    return first + np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<u{len(steps) // (n - 1)}").astype(np.int64))])


def literals(keyword: str) -> list[str]:
    """The parts of a ``LIKE`` pattern between its wildcards; a backslash makes the next character an ordinary one."""
    out, at = [""], 0
    while at < len(keyword):
        c = keyword[at]
        if c in "%_":
            out.append("")
        elif c == "\\" and at + 1 < len(keyword):
            at += 1
            out[-1] += keyword[at]
        else:
            out[-1] += c
        at += 1
    return [x for x in out if x]


def part_of(blocks: int) -> Column:
    """The folder of a ``block`` of ``blocks``."""
    return F.expr(f"cast(block * {min(PARTS, blocks)}L div {blocks}L as int)")


@dataclass
class KeywordIndex:
    """``path``: ``texts`` (id, content, block) by part, and ``postings`` (gram, first, n, steps) by bucket; ``blocks``: how
    many there are."""

    path: str
    blocks: int

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> KeywordIndex:
        """Index ``chunks`` (id, content)."""
        spark, rows = chunks.sparkSession, chunks.filter("id is not null and content is not null").select("id", "content")
        own = store.numbered(rows, ["id", F.xxhash64("content")], "number")
        blocks = F.floor(F.col("number") / BLOCK_ROWS).cast("long")
        many = rows.count() // BLOCK_ROWS + 1
        placed = own.select("id", "content", blocks.alias("block")).withColumn("part", part_of(many))
        placed.repartitionByRange("block").sortWithinPartitions("block", "id").write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("part").parquet(f"{path}/texts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many = [], 0
            for b in batches:
                number = b.column("block").to_numpy()
                for own in np.split(np.arange(len(b)), np.flatnonzero(np.diff(number)) + 1) if len(b) else ():
                    grams, block = grams_of(b.column("content").slice(own[0], len(own)).to_pylist()), number[own[0]]
                    held.append((grams, np.full(len(grams), block, np.int64)))
                    many += len(grams)
                    if many > HELD:
                        yield packed(*map(np.concatenate, zip(*held, strict=True)))
                        held, many = [], 0
            if many:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))

        written = spark.read.schema(TEXTS).parquet(f"{path}/texts").select("block", F.lower("content").alias("content"))
        made = written.mapInArrow(run, POSTINGS.removesuffix(", bucket int")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        made.repartitionByRange("bucket", "gram", "first").sortWithinPartitions("bucket", "gram", "first").write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{path}/postings")
        return cls(path, many)

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TEXTS).parquet(f"{self.path}/texts")

    def candidates(self, spark: SparkSession, keywords: list[str]) -> DataFrame | None:
        """(block, part) that may hold one of the keywords; None if that is all of them."""
        wanted = []
        for k in keywords:
            grams = {int(g) for x in literals(k.lower()) if len(x) > 2 for g in grams_of([x])}
            if not grams:
                return None
            wanted += [(k, g, len(grams)) for g in grams]
        asked = spark.createDataFrame(wanted, "keyword string, gram long, asked int")
        named = sorted({g for _, g, _ in wanted})
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in named], "gram long").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        rows = spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(named))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    yield pd.DataFrame({"gram": r.gram, "block": decoded(r.first, r.n, r.steps)})

        met = rows.select("gram", "first", "n", "steps").mapInPandas(run, "gram long, block long").join(F.broadcast(asked), "gram")
        full = met.groupBy("keyword", "block").agg(F.count_distinct("gram").alias("n"), F.first("asked").alias("asked")).filter("n = asked")
        return full.select("block").distinct()

    def narrowed(self, spark: SparkSession, keywords: list[str]) -> DataFrame:
        """The texts of the candidate blocks: named in the filter if they are few, else by folder and a join."""
        found, texts = self.candidates(spark, keywords), self.texts(spark)
        if found is None:
            return texts
        found = found.withColumn("part", part_of(self.blocks))
        few = found.orderBy("block").limit(NAMED + 1).collect()
        if len(few) > NAMED:
            return texts.join(found, ["part", "block"], "left_semi")
        runs, named = [], F.lit(False)
        for r in few:
            if runs and runs[-1][1] + 1 == r["block"]:
                runs[-1][1] += 1
            else:
                runs.append([r["block"], r["block"]])
        for lo, hi in runs:
            named = named | F.col("block").between(lo, hi)
        return texts.filter(F.col("part").isin(sorted({r["part"] for r in few})) & named)

    def hits(self, spark: SparkSession, keywords: list[str], limit: int) -> DataFrame:
        """What ``search.keyword_hits`` gives for the indexed chunks."""
        if not keywords:
            return self.texts(spark).select("id").limit(0)
        return search.keyword_hits(self.narrowed(spark, keywords), keywords, limit)


@dataclass
class GrowingIndex:
    """A keyword index of a store that grows: a ``KeywordIndex`` for each batch, made of that batch's rows alone.

    ``path``: the indexes, and ``segments`` (first, last, blocks), whose rows name the ones to search. A batch that is added
    again replaces itself. ``merge`` makes one index of all; a segment within another's batches is searched no more.
    """

    path: str

    def segment(self, first: int, last: int) -> str:
        return f"{self.path}/from={first}-to={last}"

    def add(self, chunks: DataFrame, first: int, last: int | None = None) -> None:
        """Index ``chunks`` (id, content) as the batch ``first``, or as those up to ``last``."""
        last = first if last is None else last
        made = KeywordIndex.build(chunks, self.segment(first, last))
        mark = chunks.sparkSession.createDataFrame([(first, last, made.blocks)], "first long, last long, blocks long")
        mark.write.mode("overwrite").parquet(f"{self.path}/segments/mark={first}-{last}")

    def segments(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        if not table_exists(spark, f"{self.path}/segments"):
            return []
        marks = [(r["first"], r["last"], r["blocks"]) for r in spark.read.parquet(f"{self.path}/segments").collect()]
        widest, live = -1, []
        for first, last, blocks in sorted(marks, key=lambda m: (m[0], -m[1])):
            if last > widest:
                live.append((first, last, blocks))
                widest = last
        return live

    def indexes(self, spark: SparkSession) -> list[KeywordIndex]:
        return [KeywordIndex(self.segment(first, last), blocks) for first, last, blocks in self.segments(spark)]

    def merge(self, spark: SparkSession) -> None:
        """One index in place of all; the batches that it is made of stay where they are, unread."""
        live = self.segments(spark)
        if len(live) > 1:
            whole = reduce(DataFrame.unionByName, [i.texts(spark).select("id", "content") for i in self.indexes(spark)])
            self.add(whole, live[0][0], live[-1][1])

    def hits(self, spark: SparkSession, keywords: list[str], limit: int, deleted: DataFrame | None = None) -> DataFrame:
        """What ``search.keyword_hits`` gives for all batches, without the ``deleted`` (id)."""
        texts = [i.narrowed(spark, keywords) if keywords else i.texts(spark) for i in self.indexes(spark)]
        if not texts:
            return spark.createDataFrame([], "id long")
        rows = reduce(DataFrame.unionByName, [t.select("id", "content") for t in texts])
        return search.keyword_hits(rows if deleted is None else rows.join(deleted.select("id"), "id", "left_anti"), keywords, limit)
