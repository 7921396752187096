"""The pipeline's stages on rows with nulls, copies, secrets and an empty table; revisit resolution on small records."""

import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import queries, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "the quick brown fox jumps over the lazy dog and runs away from it all before night falls on the old town"


def rows():
    fr = "le renard brun saute par dessus le chien paresseux et puis il court vers la ville avant que la nuit tombe"
    return [(1, TEXT, "en", "a", 9), (2, TEXT, "en", "a", 9), (3, fr, "fr", None, 9), (4, None, "en", "a", 0), (5, "123 !!", None, "b", 6), (6, " ".join(reversed(fr.split())) + " password=abcdefabcdef123456", None, "b", None), (None, "the dog and the town", "en", "b", 3)]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "pack_sequences":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept.append({r.doc_id for r in docs.collect()})
            if name == "secret_scan":
                texts = {r.doc_id: r.text for r in docs.collect()}
                assert texts[6].endswith("[assign]") and all(r.n_chars == len(r.text) for r in docs.collect())
    assert kept[0] == {1, 2, 3, 6, None} and kept[2] == kept[3] and 1 in kept[2] and 2 not in kept[2] and None in kept[2]
    assert {r.doc_id for r in docs.collect()} == kept[3]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the plain form of the one before left of a whole small table."""
    stages, rows = dict(corpus_pipeline.STAGES), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    after = lambda name, own: {r.doc_id: r for r in stages[name](spark, spark.createDataFrame(own, SCHEMA), sf).collect()}
    plain = brute.Language()
    plain.learn((t, lang) for _, t, lang, _, _ in rows)
    said = {r[0]: plain.predict(r[1]) for r in rows}
    sure = {d for d, (lang, score) in said.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    assert set(after("language_id", rows)) == sure
    rows = [r for r in rows if r[0] in sure]
    texts = brute.kept_lines([r[:2] for r in rows])
    assert {d: r.text for d, r in after("dedup_lines", rows).items()} == texts
    rows = [(d, texts[d], lang, source, len(texts[d])) for d, _, lang, source, _ in rows]
    component = {d: c for d, (_, c) in brute.near_duplicates([r[:2] for r in rows]).items()}
    assert set(after("near_duplicates", rows)) == {d for d, c in component.items() if d == c}
    rows = [r for r in rows if component[r[0]] == r[0]]
    got = after("secret_scan", rows)
    assert set(got) == {r[0] for r in rows}
    clean = {r[0] for r in rows if not brute.base_spans(r[1])}
    for d, text, *_ in rows:
        if d not in clean:
            assert not brute.base_spans(got[d].text), "no base secret is left"
    assert len(clean) > 100 and sum(got[d].text == t for d, t, *_ in rows if d in clean) >= len(clean) - 3
    rows, exact = [tuple(got[r[0]]) for r in rows], Tokenizer.from_file(queries.BYTE_BPE)
    pieces = {}
    for r in stages["pack_sequences"](spark, spark.createDataFrame(rows, SCHEMA), sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d, text, *_ in rows:
        ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert [(r.start, r.ids_crc32) for r in sorted(pieces[d], key=lambda r: r.piece)] == [(r.start, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in sorted(pieces[d], key=lambda r: r.piece)]
        assert sum(r.length for r in pieces[d]) == len(ids)


def test_long_white_space(spark):
    """A million spaces pass all stages."""
    docs = spark.createDataFrame([*rows(), (50, " ".join(reversed(TEXT.split())) + " " * 1_000_000 + "and the end of it", "en", "a", 0)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert sum(r.length for r in docs.collect() if r.doc_id == 50) > 900_000


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


REC = "id long, url string, ts long, type string, digest string, headers map<string,string>"


def test_revisits(spark):
    full = lambda i, u, t, d, **h: (i, u, t, "response", d, {k.replace("_", "-"): v for k, v in h.items()})
    back = lambda i, u, t, d=None, **h: (i, u, t, "revisit", d, {k.replace("_", "-"): v for k, v in h.items()})
    data = [
        full(1, "http://www.A.com/x/", 1, "d1", ETag='"1"', Content_Type="t"), full(2, "https://a.com/x", 5, "d2", ETag='"2"', Date="5"),
        back(10, "http://a.com:80/x?utm_source=f#top", 3, ETag='W/"1"', Content_Type="no", Date="3"), back(11, "http://a.com/x", 9, ETag='"1"'),
        back(12, "http://a.com/x", 0), back(13, "http://b.com/", 4), back(14, None, 4), back(15, "http://a.com/x", None),
        (16, "http://a.com/x", 6, "revisit", "d2", None), back(17, "http://a.com/x", 7), back(18, "http://a.com/x", 5, "d2"), back(18, "http://a.com/x", 5, "d2"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in data], REC + ", status string")
    out = sorted(((r.id, r.status, r.response_id, r.digest) for r in warc.resolve_revisits(df).collect()), key=str)
    assert out == [(10, "resolved", 1, "d1"), (11, "mismatch", None, None), (12, "missing", None, None), (13, "missing", None, None), (14, "missing", None, None), (15, "missing", None, None), (16, "resolved", 2, "d2"), (17, "unchecked", 2, "d2"), (18, "resolved", 2, "d2"), (18, "resolved", 2, "d2")]
    merged = next(r.headers for r in warc.resolve_revisits(df).collect() if r.id == 10)
    assert merged == {"etag": 'W/"1"', "content-type": "t", "date": "3"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize(("url", "want"), [("HTTP://WWW.x.org:443/a/index.html?b=2&a=1&ref=q#z", "x.org/a?a=1&b=2"), ("x.org", "x.org"), ("", ""), (None, None)])
def test_canonical(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want
