"""Exact vector search and keyword search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block take that many bytes at most; scores of queries and vectors that a task holds at once.
QUERY_BYTES, SCORES = 64 << 20, 4 << 20
FOUND = "query_id long, doc_id long, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is nearly zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-8, 0.0).otherwise(dot(a, b) / size)


def unit_score(cos: Column) -> Column:
    """(1 + cosine) / 2, rounded so that ties are ties on any engine."""
    return F.round((cos + 1) / 2, 6)


def vector_top_k(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.5, deleted: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, rank) of the k best at or above the threshold; tombstones are left out before the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if deleted is not None:
        vectors = vectors.join(deleted, "doc_id", "left_anti")
    scored = vectors.filter(F.col("doc_id").isNotNull() & F.col("embedding").isNotNull()).select("doc_id", unit_score(cosine(F.col("embedding"), q)).alias("score"))
    best = scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def block_top_k(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, threshold: float) -> DataFrame:
    """(query_id, doc_id, score): the k best of each task for a block of queries (a row each), in one pass over the vectors.
    Vectors that are null or hold nulls take no part; a task scores as many at once as SCORES allows."""
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = sent.value
        best, rows = None, max(1, SCORES // max(1, len(unit)))
        for whole in batches:
            for lo in range(0, len(whole), rows):
                b = whole.iloc[lo : lo + rows]
                x = np.stack(b["embedding"].to_numpy()).astype(float)
                score = np.round((1 + unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T) / 2, 6)
                found = np.broadcast_to(b["doc_id"].to_numpy(np.int64), score.shape)
                if best is not None:
                    score, found = np.hstack([best[0], score]), np.hstack([best[1], found])
                at = np.lexsort((found, -score), axis=-1)[:, :k]
                best = np.take_along_axis(score, at, 1), np.take_along_axis(found, at, 1)
        if best is not None:
            keep = best[0].ravel() >= threshold
            yield pd.DataFrame({"query_id": np.repeat(ids, best[0].shape[1])[keep], "doc_id": best[1].ravel()[keep], "score": best[0].ravel()[keep]})

    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    return vectors.filter(whole & F.col("doc_id").isNotNull()).select("doc_id", "embedding").mapInPandas(run, FOUND)


def best_ranks(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def multi_query_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank); the queries go in blocks of bounded size against all vectors, which are read
    once a block. A task keeps the k best of each query it has seen, so the shuffle carries k rows per query and task.
    """
    n, widest = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // max(1, QUERY_BYTES // (8 * max(1, widest or 1)))))
    parts = [queries.sparkSession.createDataFrame([], FOUND)]
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toPandas()
        if len(own):
            parts.append(block_top_k(vectors, own["query_id"].to_numpy(np.int64), np.array(own["embedding"].tolist(), float), k, threshold))
    return best_ranks(reduce(DataFrame.unionByName, parts), k)


def keyword_hits(chunks: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """Ids whose content is like any keyword, in any case; ``%`` and ``_`` in keywords are wildcards; lowest ids first."""
    if not keywords:
        return chunks.select("id").limit(0)
    like = reduce(lambda a, b: a | b, [F.lower("content").like(f"%{k.lower()}%") for k in keywords])
    return chunks.filter(like).select("id").distinct().orderBy("id").limit(limit)
