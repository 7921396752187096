"""The jobs: what they write, two runs over growing input, and their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import passage_store, purge, queries

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, source string, extra int"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(columns).collect()) and want


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def text_of(i):
    return " ".join(f"Sentence {k} of {i}." for k in range(i % 14)) if i % 5 else [None, "", " \n\t", "No stop here", "一句。两句！三句？"][i // 5 % 5]


def put(spark, folder, ids):
    """A new file of the table."""
    spark.createDataFrame([(i, text_of(i), f"src{i % 3}" if i % 4 else None, 0) for i in ids], DOCS).coalesce(1).write.mode("append").parquet(folder)


def taken(spark, folder, out, marks, **config):
    return passage_store.run(spark, folder, out, marks, size=4, overlap=1, **config)


def test_passages_of_growing_input(spark, tmp_path):
    folder, out, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    put(spark, folder, range(40))
    put(spark, folder, range(40, 50))
    first = taken(spark, folder, out, marks, files_per_batch=1)
    assert sum(b["read"]["rows"] for b in first) == 50 and len(first) == 2
    plain = lambda ids: passage_store.passages(spark.createDataFrame([(i, text_of(i), f"src{i % 3}" if i % 4 else None) for i in ids], passage_store.DOCUMENTS), 4, 1)
    before = rows_of(passage_store.read_store(spark, out))
    assert before == rows_of(plain(range(50)))
    put(spark, folder, range(45, 70))  # five of them are known
    second = taken(spark, folder, out, marks)
    assert [b["read"]["rows"] for b in second] == [25], "only the new file is read"
    assert sum(b["written"]["documents"] for b in second) == 20, "only new documents are written"
    after = rows_of(passage_store.read_store(spark, out))
    assert after == rows_of(plain(range(70))) and set(before) < set(after)
    assert taken(spark, folder, out, marks) == [] and rows_of(passage_store.read_store(spark, out)) == after


def test_passages_of_documents(spark):
    docs = [(i, " ".join(f"Sentence {k}." for k in range(n)), "s") for i, n in enumerate([1, 3, 4, 5, 7, 8])]
    docs += [(10, None, "s"), (11, "", "s"), (12, " \n", "s"), (13, "x" * (50 * 2**20 + 1), "s"), (14, "y" * (10 * 2**20 + 1), "s")]
    rows = passage_store.passages(spark.createDataFrame(docs, passage_store.DOCUMENTS), 4, 1).filter("doc_id <> 14").collect()
    numbers = lambda r: [int(w[:-1]) for w in r["content"].split() if w[0].isdigit()]
    cut = {i: [numbers(r) for r in sorted(rows, key=lambda r: r["chunk_index"] or 0) if r["doc_id"] == i] for i in range(6)}
    assert cut == {0: [[0]], 1: [[0, 1, 2]], 2: [[0, 1, 2, 3]], 3: [[0, 1, 2, 3], [3, 4]], 4: [[0, 1, 2, 3], [3, 4, 5, 6]], 5: [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7]]}
    without = {r["doc_id"]: (r["status"], r["total_chunks"], r["content"], r["tokens"]) for r in rows if r["doc_id"] > 9}
    assert without == {10: ("empty", 0, None, None), 11: ("empty", 0, None, None), 12: ("blank", 0, None, None), 13: ("too_large", 0, None, None)}
    with pytest.raises(ValueError):
        passage_store.passages(spark.createDataFrame(docs, passage_store.DOCUMENTS), 2, 2)


def test_rows_without_id_and_with_one_id(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(None, "Lost.", "s", 0), (1, "One.", "s", 0), (1, "One.", "s", 0), (2, "Two.", "", 0)], DOCS).write.parquet(folder)
    seen = taken(spark, folder, out, f"{tmp_path}/marks")
    assert seen[0]["read"] == {"rows": 4, "without_id": 1}
    assert sorted((r["doc_id"], r["source"]) for r in passage_store.read_store(spark, out).collect()) == [(1, "s"), (2, None)]


def purge_tables(spark, tmp_path, documents, labels, vectors):
    spark.createDataFrame(documents, DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/v")
    return [f"{tmp_path}/{t}" for t in "dlv"]


def test_purge(spark, tmp_path):
    documents = [(i, f"text {i}", ["a", "b", "c", "", None][i % 5], 0) for i in range(20)] + [(None, "no id", "a", 0), (3, "again", "a", 0)]
    labels = [(0, 1, 1), (0, 1, 0), (1, 0, None), (5, 1, 0), (99, 1, 1), (None, 1, 1), (6, 0, 1)]
    vectors = [(i, 0, [float(i)]) for i in range(0, 25, 2)] + [(7, 0, None), (None, 0, [1.0])]
    paths = purge_tables(spark, tmp_path, documents, labels, vectors)
    out = f"{tmp_path}/out"
    wrote = purge.run(spark, *paths, out, sources=["c"], label_columns=["toxic"], shards=3)
    gone = {0, 6} | {i for i in range(20) if i % 5 == 2}
    chunks = purge.read_output(spark, out, "chunks").collect()
    assert sorted(r["id"] for r in chunks if r["id"] is not None) == sorted([*(set(range(20)) - gone), 3]) and len(chunks) == wrote["chunks"]
    kept = [i for i in range(0, 20, 2) if i not in gone]
    vecs = purge.read_output(spark, out, "vectors").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["node_id"], r["shard"], list(r["embedding"])) for r in vecs] == [(i, n, n % 3, [float(i)]) for n, i in enumerate(kept)]
    report = {r["source"]: tuple(r)[:5] for r in purge.read_output(spark, out, "report").collect()}
    assert report == {"a": (6, 5, 0, 1, 1), "b": (4, 3, 0, 1, 1), "c": (4, 0, 4, 0, 0), None: (8, 8, 0, 0, 4)}
    again = lambda: [rows_of(purge.read_output(spark, out, t)) for t in purge.OUTPUTS]
    before = again()
    purge.run(spark, *paths, out, sources=["c"], label_columns=["toxic"], shards=3)
    assert again() == before
    purge.run(spark, *paths, out, sources=["a", "c"], label_columns=[], shards=3)
    assert {r["source"] for r in purge.read_output(spark, out, "chunks").select("source").distinct().collect()} == {"b", None}, "no old partition stays"


def test_purge_of_empty_tables(spark, tmp_path):
    paths = purge_tables(spark, tmp_path, [], [], [])
    assert purge.run(spark, *paths, f"{tmp_path}/out", sources=[], label_columns=["toxic"]) == {"chunks": 0, "vectors": 0, "report": 0}


@pytest.mark.parametrize("job", ["passage_store", "purge"])
def test_command_line(spark, sf, tmp_path, job):
    config = json.loads((ROOT / f"jobs/{job}.json").read_text())
    own = {"passage_store": {"documents": f"{sf}/documents.parquet", "out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/marks"}}
    own["purge"] = {"documents": f"{sf}/documents.parquet", "labels": f"{sf}/labels.parquet", "embeddings": f"{sf}/embeddings.parquet", "out": f"{tmp_path}/out"}
    command = [sys.executable, "-m", f"jobs.{job}", "--config", f"jobs/{job}.json", *[x for k, v in own[job].items() for x in (f"--{k}", v)]]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300, env={**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[4] --conf spark.sql.shuffle.partitions=4 pyspark-shell"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert "wrote" in done.stderr and "read" in done.stderr
    if job == "purge":
        purge.run(spark, *[own[job][k] for k in ("documents", "labels", "embeddings")], f"{tmp_path}/here", **config)
        for t in purge.OUTPUTS:
            assert rows_of(purge.read_output(spark, f"{tmp_path}/out", t)) == rows_of(purge.read_output(spark, f"{tmp_path}/here", t))
    else:
        docs = spark.read.parquet(own[job]["documents"]).select("doc_id", "text", "source")
        assert rows_of(passage_store.read_store(spark, f"{tmp_path}/out")) == rows_of(passage_store.passages(docs, config["size"], config["overlap"]))
        assert passage_store.read_store(spark, f"{tmp_path}/out").select(F.countDistinct("doc_id")).first()[0] == docs.count()
