"""The memory of embeddings, and deletes as bitmaps."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import embedding, memo, tombstones


def never(texts):
    if texts:
        raise ValueError("nothing is left to embed")
    return np.zeros((0, 8), np.float32)


def rows_of(df):
    return sorted((r["id"], r["t"], tuple(round(x, 6) for x in r["embedding"])) for r in df.collect())


def test_memo(spark, tmp_path):
    of, own = embedding.hashing_embedder(8), memo.Memo(f"{tmp_path}/m")
    texts = [(i, f"text {i % 7}") for i in range(20)] + [(30, None), (31, " \n"), (32, "")]
    first = spark.createDataFrame(texts, "id int, t string")
    more = spark.createDataFrame([*texts[:3], (40, "new"), (41, "new")], "id int, t string")
    want = rows_of(embedding.embed_texts(first, "t", of))
    assert rows_of(own.embed(first, "t", of, 1)) == want
    assert rows_of(own.embed(first, "t", never, 2)) == want, "the second run embeds nothing"
    assert rows_of(own.embed(more, "t", of, 3)) == rows_of(embedding.embed_texts(more, "t", of))
    counts = lambda m: sorted(tuple(r) for r in m.counts(spark).collect())
    assert counts(own) == [(1, 0, 7), (2, 7, 0), (3, 3, 1)]
    own.embed(more, "t", of, 3)
    assert counts(own) == [(1, 0, 7), (2, 7, 0), (3, 3, 1)], "a run again replaces itself"
    # By age: only what run 3 made or used. By number: the last used.
    aged = own.kept(spark, f"{tmp_path}/aged", since=3)
    assert sorted(r.text for r in aged.entries(spark).collect()) == ["new", "text 0", "text 1", "text 2"]
    assert rows_of(aged.embed(more, "t", never, 4)) == rows_of(own.embed(more, "t", never, 4))
    assert aged.embed(first.filter("id = 5"), "t", of, 5).count() == 1
    few = own.kept(spark, f"{tmp_path}/few", most=4)
    assert sorted(r.text for r in few.entries(spark).collect()) == ["new", "text 0", "text 1", "text 2"]


def test_memo_compares_texts_with_equal_hashes(spark, tmp_path):
    own = memo.Memo(f"{tmp_path}/m")
    one = spark.createDataFrame([("right",)], "t string")
    h = one.select(F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")).first()
    spark.createDataFrame([(h.h1, h.h2, "wrong", [9.0])], "h1 long, h2 long, text string, embedding array<float>").write.parquet(f"{tmp_path}/m/entries/run=1")
    got = own.embed(one, "t", lambda texts: np.full((len(texts), 1), 5, np.float32), 2).collect()
    assert [list(r.embedding) for r in got] == [[5.0]]
    assert [(r.run, r.hits, r.misses) for r in own.counts(spark).collect() if r.run == 2] == [(2, 0, 1)]


def test_tombstones(spark, tmp_path):
    spark.range(100_000).select("id", (F.col("id") % 10).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n")).repartition(2).write.parquet(f"{tmp_path}/t")
    own = tombstones.Tombstones(f"{tmp_path}/t", f"{tmp_path}/marks")
    ids = lambda t: {r.id for r in t.read(spark).select("id").collect()}
    whole = set(range(100_000))
    assert ids(own) == whole
    small = own.delete(spark, F.col("id").isin(5, 77_777, 99_999))
    assert ids(own) == whole - {5, 77_777, 99_999}
    assert sum(f.stat().st_size for f in (tmp_path / "marks").rglob("*.parquet")) < 10_000, "bytes as of what is deleted"
    rng = random.Random(1)
    some = rng.sample(range(100_000), 30_000)
    own.delete(spark, keys=spark.createDataFrame([(i,) for i in [*some, 5, 10**9]], "id long"))
    own.delete(spark, F.col("n") == 10)  # null for every third row: picks nothing there
    left = whole - set(some) - {5, 77_777, 99_999, 10}
    assert ids(own) == left and own.read(spark).columns == ["id", "k", "n"] and small.startswith(f"{tmp_path}/marks")
    fresh = own.compact(spark, f"{tmp_path}/t2", f"{tmp_path}/marks2")
    assert ids(fresh) == left and fresh.bitmaps(spark).count() == 0
    fresh.delete(spark, F.lit(True))
    assert ids(fresh) == set()


def test_tombstones_of_repeated_rows_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id long, bits string").coalesce(1).write.parquet(f"{tmp_path}/t")
    own = tombstones.Tombstones(f"{tmp_path}/t", f"{tmp_path}/marks")
    own.delete(spark, F.col("bits") == "a")
    own.delete(spark, F.col("bits") == "a")
    assert [tuple(r) for r in own.read(spark).collect()] == [(1, "b")]
    spark.createDataFrame([], "id long").write.parquet(f"{tmp_path}/e")
    none = tombstones.Tombstones(f"{tmp_path}/e", f"{tmp_path}/marks_e")
    none.delete(spark, F.col("id") > 0)
    assert none.read(spark).count() == 0


def test_an_embedder_gets_few_texts_at_once():
    from docloom import storage

    n, sizes = storage.GIVEN // 2000, []
    batch = pa.RecordBatch.from_pydict({"h1": list(range(3 * n + 2)), "text": ["x" * 2000] * 3 * n + [None, "y" * 3 * storage.GIVEN]})

    def of(texts):
        sizes.append(sum(len(t or "") for t in texts))
        return np.ones((len(texts), 2))

    out = list(embedding.embedded([batch], "text", of))
    assert sum(map(len, out)) == len(batch) and max(sizes[:-1]) <= storage.GIVEN and sizes[-1] == 3 * storage.GIVEN
    assert sum((b.column("h1").to_pylist() for b in out), []) == list(range(len(batch)))
