"""Fusion, store, files, streaming, and every named query against its SQL."""

import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import embedding, fusion, postings, search, store
from docloom.plans import queries as core
from docloom.plans.retrieve import Retriever
from docloom.sources import files
from docloom.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(pdf):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    if name in core.SQL:
        want = duck.sql(core.SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fusion_golden(spark):
    lists = [(n, 1, 1.0) for n in range(3)] + [(0, 2, 0.8), (1, 3, 0.9), (1, 2, 0.8)]
    out = {r.doc_id: r for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(lists, "list_id int, doc_id long, score double")).collect()}
    assert out[1].final_score == round(1.4918032786885247, 6) and out[2].rrf_score == round(1 / 62 + 1 / 63, 10)


def test_context(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "ctx string, rank int")
    assert fusion.context(df).first()["context"] == "[1] A\n\n[2] B\n\n"
    assert fusion.context(df.limit(0)).first()["context"] == ""


def test_retriever(spark, sf):
    r = Retriever(core.chunks(spark, sf), core.vectors(spark, sf))
    out = r.search("docker the", [core.query_vector(spark, sf, 0)]).collect()
    assert 0 < len(out) <= 20 and [x["rank"] for x in out] == list(range(1, len(out) + 1))
    assert r.search("the", [], reranking=True).count() > 0


def test_empty_store(spark):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    assert store.deleted_stats(none, none.select("doc_id")).first()["deletion_ratio"] == 0.0


def packed(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_office(spark):
    slide = '<s xmlns:a="u"><a:p><a:r><a:t>slide {}</a:t></a:r></a:p></s>'
    found = {
        "a.docx": packed(**{"word/document.xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:t>two &amp; three</w:t></w:p></w:d>'}),
        "b.pptx": packed(**{f"ppt/slides/slide{i}.xml": slide.format(i) for i in (10, 2)}),
        "c.xlsx": packed(**{"xl/sharedStrings.xml": '<sst xmlns="u"><si><t>name</t></si><si><r><t>to</t></r><r><t>tal</t></r></si></sst>', "xl/worksheets/sheet1.xml": '<w xmlns="u"><row><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c></row><row/><row><c><v>7</v></c><c t="inlineStr"><is><t>in</t></is></c></row></w>'}),
        "broken.docx": b"PK no archive",
        "bad.xlsx": packed(**{"xl/worksheets/sheet1.xml": "<w>"}),
        "other.bin": b"x",
    }
    rows = spark.createDataFrame([(n, len(b), "m", bytearray(b)) for n, b in found.items()], "filename string, file_size long, mime_type string, content binary")
    got = {r.filename: r.text for r in files.extracted(rows).collect()}
    assert got == {"a.docx": "one line\ntwo & three", "b.pptx": "slide 2\nslide 10", "c.xlsx": "name\ttotal\n7\tin", "broken.docx": None, "bad.xlsx": None, "other.bin": None}


def test_html():
    assert files.html_text("<head><title>t</title></head><p>a&amp;b</p><script>x()</script><div>c  d</div>") == "a&b\nc d"


def test_streaming_equals_batch(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    for i in range(4):
        (folder / f"f{i}.txt").write_text("\n".join(f"Line {i} {k}. Another one." for k in range(60)))
    (folder / "empty.txt").write_text("")  # Spark reads no file without bytes
    (folder / "blank.txt").write_text(" \n")
    of = embedding.hashing_embedder(16)
    own_index = postings.GrowingIndex(f"{out}/keywords")
    ingest.ingest(spark, str(folder), out, of, files_per_batch=2, index=own_index)
    got = ingest.committed(spark, out, "chunks").select("filename", "chunk_index", "content").collect()
    want = ingest.chunk_rows(files.extracted(files.validated(files.read_files(spark, str(folder))).filter("status = 'ok'")), of).select("filename", "chunk_index", "content").collect()
    assert sorted(got) == sorted(want) and {r.filename for r in got} == {f"f{i}.txt" for i in range(4)}
    steps = {}
    for r in ingest.progress(spark, out).orderBy("progress").collect():
        steps.setdefault(r["task_id"], []).append((r["progress"], r["status"], r["reason"]))
    assert steps["blank.txt"] == [(10, "READING", "empty"), (100, "REJECTED", "empty")]
    assert steps["f1.txt"] == [(10, "READING", None), (30, "PARSING", None), (60, "EMBEDDING", None), (70, "STORING", None), (80, "STORED", None), (100, "COMPLETED", None)]
    # The next run knows names and ids without the chunks of the first.
    os.rename(tmp_path / "out" / "chunks", tmp_path / "aside")
    (folder / "f9.txt").write_text("New text.")
    (folder / "deeper").mkdir()
    (folder / "deeper" / "f1.txt").write_text("A known name.")
    ingest.ingest(spark, str(folder), out, of, index=own_index)
    own = ingest.committed(spark, out, "chunks").collect()
    assert [r.filename for r in own] == ["f9.txt"] and own[0]["id"] == len(want)
    for batch in os.listdir(tmp_path / "aside"):
        os.rename(tmp_path / "aside" / batch, tmp_path / "out" / "chunks" / batch)
    assert ingest.committed(spark, out, "vectors").count() == len(want) + 1
    ids = [r["id"] for r in ingest.committed(spark, out, "chunks").select("id").collect()]
    assert sorted(ids) == list(range(len(want) + 1))
    # The index has taken each batch after its commit: it finds what a scan of the committed chunks does.
    whole = ingest.committed(spark, out, "chunks").select("id", "content")
    for ks in (["line 3 1", "new text"], ["another%one"]):
        assert own_index.hits(spark, ks, 100).collect() == search.keyword_hits(whole, ks, 100).collect()


def test_inserts(spark, tmp_path):
    """Ids over batches, a batch again, rows without a vector, and vectors that are held."""
    out = f"{tmp_path}/store"
    rows = spark.createDataFrame([("b", [1.0]), ("a", None), ("c", [2.0])], "name string, embedding array<double>")
    more = spark.createDataFrame([("z", [3.0]), ("y", [4.0])], rows.schema)
    held = lambda name: spark.read.parquet(f"{out}/{name}").drop("batch")
    for batch, own in ((0, rows), (1, rows), (1, more), (2, rows.limit(0))):
        store.insert(own, out, batch, ["name"])
    assert sorted((r["id"], r["name"]) for r in held("chunks").collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "y"), (4, "z")]
    assert sorted((r["doc_id"], *r["embedding"]) for r in held("vectors").collect()) == [(1, 1.0), (2, 2.0), (3, 4.0), (4, 3.0)]
    vectors = lambda *v: spark.createDataFrame(v, "doc_id long, embedding array<double>")
    path = f"{out}/new"
    store.insert_new(vectors((1, [1.0]), (2, None), (None, [5.0])), path, 0)
    for _ in range(2):
        store.insert_new(vectors((1, [9.0]), (2, [8.0]), (2, [7.0]), (3, [6.0])), path, 1)
    assert sorted((r["doc_id"], *r["embedding"]) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 7.0), (3, 6.0)]
    assert sorted(r["id"] for r in store.delete_ids(held("chunks"), spark.createDataFrame([(0,), (3,), (3,), (77,)], "id long")).collect()) == [1, 2, 4]
