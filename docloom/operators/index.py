"""An approximate vector index: cells around centres, kept as a table partitioned by cell.

The centres are fitted on a sample of at most SAMPLE vectors, the lowest by a hash of their id; every vector is put in the
cell of its nearest centre. A search reads the cells nearest to its queries only, and scores their vectors exactly. How
many cells that are is measured when the index is built: as many as hold RECALL of the nearest vectors of some of the
sample. Vectors lie denser in the whole table than in its sample, so the search finds at least about that share.
Vectors that are null, hold nulls or are zero have no direction: they are left out. An empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, ROUNDS = 20_000, 12
#: Share of the exact answers to find; vectors of the sample, and their nearest ones, that it is measured on.
RECALL, ASKED, NEAREST = 0.97, 256, 20
#: Scores that a task holds at once; queries that are sent at once.
SCORES, QUERIES = 4 << 20, 20_000
FOUND = "query_id long, doc_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def usable(vectors: DataFrame, key: str) -> DataFrame:
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(fit & F.col(key).isNotNull()).select(key, "embedding")


def fitted(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Centres of length 1 by spherical k-means; an empty cell takes the vector that its own centre fits least."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        score = x @ centres.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(score.max(axis=1))[: len(empty)]]
        centres = unit(sums)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray) -> int:
    """How many cells nearest to a vector hold RECALL of the others that are nearest to it, over ASKED rows of ``x``."""
    own, asked = (x @ centres.T).argmax(axis=1), x[:ASKED]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -2  # a vector finds itself in its own cell
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(NEAREST, len(x) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    rank = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(rank[min(len(rank) - 1, int(np.ceil(RECALL * len(rank))))]) + 1 if len(rank) else len(centres)


@dataclass
class VectorIndex:
    """``path``: a table (doc_id, embedding) partitioned by ``cell``; ``centres``: a row for each cell; ``probes``: cells
    that a search reads for each query."""

    path: str
    centres: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Index all of ``vectors`` (doc_id, embedding). By default about the square root of their number of cells."""
        spark, rows = vectors.sparkSession, usable(vectors, "doc_id")
        sample = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).select("embedding").toPandas()
        x = unit(np.array(sample["embedding"].tolist(), np.float64).reshape(len(sample), -1))
        centres = fitted(x, cells or max(1, min(4096, int(rows.count() ** 0.5)))) if len(x) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own, step = [], max(1, SCORES // max(1, len(sent.value)))
                for lo in range(0, len(b), step):
                    own.append((unit(np.stack(b["embedding"].to_numpy()[lo : lo + step]).astype(float)) @ sent.value.T).argmax(axis=1))
                yield b.assign(cell=np.concatenate(own) if own else 0)

        # Rows of a cell are dealt over a few tasks, so that a very full cell isn't one.
        dealt = rows.mapInPandas(run, "doc_id long, embedding array<float>, cell int").repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
        return cls(path, centres, probes_for(x, centres) if len(x) else 0)

    def search(self, spark: SparkSession, queries: DataFrame, k: int, threshold: float = 0.5, probes: int | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best found in the ``probes`` nearest cells of each query (query_id,
        embedding). Queries go in blocks of about QUERIES, each read, sent and searched for in one pass over its cells."""
        probes = probes or self.probes
        asked, parts = usable(queries, "query_id"), []
        blocks = max(1, -(-asked.count() // QUERIES))
        for block in range(blocks if len(self.centres) else 0):
            own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
            if len(own):
                parts.append(self.found(spark, own["query_id"].to_numpy(np.int64), unit(np.array(own["embedding"].tolist(), float)), k, threshold, probes, deleted))
        if not parts:
            return spark.createDataFrame([], FOUND + ", rank int")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= k)

    def found(self, spark: SparkSession, ids: np.ndarray, q: np.ndarray, k: int, threshold: float, probes: int, deleted: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, score): the best k of each batch of the cells that a block of queries reads."""
        near = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
        of_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((ids, q, of_cell))
        rows = spark.read.parquet(self.path).filter(F.col("cell").isin(list(of_cell)))
        if deleted is not None:
            rows = rows.join(deleted, "doc_id", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own_ids, own_q, cells = sent.value
            for b in batches:
                for cell, part in b.groupby("cell", sort=False):
                    asking = cells[int(cell)]
                    step = max(1, SCORES // len(asking))
                    for lo in range(0, len(part), step):
                        some = part.iloc[lo : lo + step]
                        doc = some["doc_id"].to_numpy(np.int64)
                        score = np.round((1 + own_q[asking] @ unit(np.stack(some["embedding"].to_numpy()).astype(float)).T) / 2, 6)
                        at = np.lexsort((np.broadcast_to(doc, score.shape), -score), axis=-1)[:, :k]
                        best = np.take_along_axis(score, at, 1)
                        keep = best.ravel() >= threshold
                        yield pd.DataFrame({"query_id": np.repeat(own_ids[asking], at.shape[1])[keep], "doc_id": doc[at].ravel()[keep], "score": best.ravel()[keep]})

        return rows.select("doc_id", "embedding", "cell").mapInPandas(run, FOUND)
