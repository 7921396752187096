"""The proximity graph against a full scan, and its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import graph, search
from docloom.plans import queries as core

SCHEMA = "doc_id long, embedding array<float>"


def tables(spark, x, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(x)), [[float(c) for c in v] for v in x], strict=True)), SCHEMA)


def asked(df):
    return df.select(F.col("doc_id").alias("query_id"), "embedding")


def compared(index, spark, v, q, k=20):
    """Recall against the exact search, and the share of vectors that were scored."""
    got = {(r.query_id, r.doc_id) for r in index.search(spark, q, k).collect()}
    want = {(r.query_id, r.doc_id) for r in search.multi_query_top_k(v, q, k).collect()}
    scored = index.walk(spark, q, k).filter("doc_id is null").groupBy("query_id").agg(F.sum("scored").alias("n")).agg(F.avg("n")).first()[0]
    return len(got & want) / len(want), scored / v.count()


def mixtures(spark, v, n=60):
    """Queries that lie where no vector does."""
    x, rng = np.array([r.embedding for r in v.orderBy("doc_id").collect()]), np.random.default_rng(9)
    return asked(tables(spark, np.einsum("ab,abd->ad", rng.normal(size=(n, 6)), x[rng.integers(0, len(x), (n, 6))])))


@pytest.mark.parametrize("shard_rows", [None, 300])
def test_recall(spark, sf, tmp_path, shard_rows):
    v = core.vectors(spark, "/root/testdata/sf0.1")
    index = graph.GraphIndex.build(v, f"{tmp_path}/g", shard_rows)
    recall, share = compared(index, spark, v, mixtures(spark, v))
    assert recall >= 0.93 and share < 0.9
    recall, _ = compared(index, spark, v, asked(v.filter("doc_id % 20 = 0")))
    assert recall >= 0.95


def test_share_of_clustered_vectors(spark, tmp_path):
    """6000 vectors around 60 centres: less than a fifth of them is scored."""
    rng = np.random.default_rng(4)
    v = tables(spark, rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 24)))
    recall, share = compared(graph.GraphIndex.build(v, f"{tmp_path}/g"), spark, v, asked(v.filter("doc_id % 50 = 0")))
    assert recall >= 0.95 and share < 0.2


def test_every_vector_is_found(spark, tmp_path):
    """Clusters far apart, chains and copies: each vector, asked for, finds itself or an equal one."""
    rng = np.random.default_rng(1)
    parts = [np.eye(16)[i % 16] + 1e-3 * rng.normal(size=16) for i in range(800)] + [np.eye(16)[3]] * 300 + [rng.normal(size=16) for _ in range(200)]
    parts += [[np.cos(a), np.sin(a), *[0.0] * 14] for a in np.linspace(0, 3, 300)]
    v = tables(spark, parts)
    got = graph.GraphIndex.build(v, f"{tmp_path}/g").search(spark, asked(v), 1).collect()
    assert len(got) == len(parts) and all(r.score >= 0.999999 for r in got)


def test_equal_vectors_and_repeated_ids(spark, tmp_path):
    v = tables(spark, [[1.0, 0.0]] * 50 + [[0.0, 1.0]] * 3 + [[0.0, 1.0], [1.0, 1.0]], [*range(50), 60, 61, 62, 60, 60])
    index = graph.GraphIndex.build(v, f"{tmp_path}/g")
    rows = index.search(spark, asked(tables(spark, [[2.0, 0.0]], [7])), 8).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(i, 1.0) for i in range(8)]
    assert index.search(spark, asked(tables(spark, [[0.0, 1.0]], [7])), 100).count() == 55


def test_soft_deletes(spark, tmp_path):
    v = core.vectors(spark, "/root/testdata/sf0.1")
    index, gone = graph.GraphIndex.build(v, f"{tmp_path}/g", 700), v.filter("doc_id % 3 > 0").select("doc_id")
    q = asked(v.filter("doc_id % 50 = 0"))
    got = {(r.query_id, r.doc_id, r.score) for r in index.search(spark, q, 20, deleted=gone.union(gone).union(spark.createDataFrame([(None,), (10**9,)], "doc_id long"))).collect()}
    want = {(r.query_id, r.doc_id, r.score) for r in search.multi_query_top_k(v.join(gone, "doc_id", "left_anti"), q, 20).collect()}
    assert not {d for _, d, _ in got if d % 3} and len(got & want) / len(want) >= 0.95
    assert index.search(spark, q, 20, deleted=v.select("doc_id")).count() == 0


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    empty = graph.GraphIndex.build(none, f"{tmp_path}/e")
    assert empty.search(spark, asked(tables(spark, [[1.0]])), 3).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [0.0, 0.0]), (None, [1.0, 1.0])], SCHEMA)
    index = graph.GraphIndex.build(odd, f"{tmp_path}/o")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in index.search(spark, asked(odd), 3).collect()] == [(1, 1, 1)]
    assert index.search(spark, asked(none), 3).count() == 0
    assert index.search(spark, asked(tables(spark, [[-1.0, 0.0]])), 3).count() == 0, "below the threshold"


def test_blocks_of_queries(spark, tmp_path, monkeypatch):
    v = tables(spark, np.random.default_rng(2).normal(size=(200, 8)))
    index = graph.GraphIndex.build(v, f"{tmp_path}/g")
    want = sorted(index.search(spark, asked(v), 5).collect())
    monkeypatch.setattr(graph, "QUERIES", 30)
    assert sorted(index.search(spark, asked(v), 5).collect()) == want


def test_pairs_are_scored_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(graph, "SCORED", 7)
    rng = np.random.default_rng(3)
    x, y, a, b = rng.random((20, 4)), rng.random((9, 4)), rng.integers(0, 20, 50), rng.integers(0, 9, 50)
    assert np.allclose(graph.dots(x, a, y, b), (x[a] * y[b]).sum(axis=1))
    assert graph.dots(x, a[:0], y, b[:0]).shape == (0,)
