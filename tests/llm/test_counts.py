"""Token counts against the library; exact top-k against a full scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import mtree, queries, token_counts
from docloom.storage import cut

WORD = queries.public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(spark, sf):
    exact = Tokenizer.from_file(WORD)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, sf).collect()}
    want = {d: (len(t.encode()), len(exact.encode(t, add_special_tokens=False).ids)) for d, t in docs}
    assert got == {d: (*x, x[1] > 2048) for d, x in want.items()}


def test_token_count_edges(spark):
    exact = Tokenizer.from_file(WORD)
    texts = [None, "", " ", "It's 123 <|endoftext|>x<|startoftext|>", "漢字 ΑΣ Σ İstanbul ﬁ é", "a" * 5000, "w'll " * 60000, "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250))), "²½ªº ' '' 's!'s", "x\x1cy\x85z\xa0a"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "two words", "z"), (1, "", "z"), (2**60 + 1, "big", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
    out = token_counts.count_tokens(docs, WORD).collect()
    want = sorted((str(d), len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert token_counts.count_tokens(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("held", [300, 10**7])
def test_rows_of_sums_are_no_more_than_rows_of_postings(spark, sf, monkeypatch, held):
    """With 100 blocks, of which a task's postings of one flush cover few."""
    monkeypatch.setattr(token_counts, "BLOCK", 2)
    monkeypatch.setattr(token_counts, "HELD", held)
    exact = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 200").select("doc_id", "text")
    # Rare pre-tokens, and one that is in every document but not hot in a block.
    rows = docs.selectExpr("doc_id as row", "cast(doc_id as string) as doc_id", "0L as n_bytes", "concat(text, ' common', doc_id % 7) as text")
    dealt = token_counts.frequencies(rows.repartition(8), WORD).repartition(8, "pretoken").sortWithinPartitions("pretoken").persist()
    made = token_counts.counted(dealt, WORD).persist()
    postings, sums = dealt.filter("pretoken is not null").count(), made.filter("heads is null").count()
    assert sums <= postings and (held > 10**6 or sums > 800)
    assert made.agg({"places": "count"}).first()[0] == sums
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "BLOCK", 2)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORD).collect()}
    assert got == {r.doc_id: len(exact.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    dealt.unpersist(), made.unpersist()


def test_large_frequencies():
    """Frequencies and sums beyond a byte, two bytes and four."""
    times = [[1], [255, 1], [256, 1, 2], [1, 1], [70_000]]
    raw = pd.Series([token_counts.packed(t) for t in times])
    assert token_counts.frequencies_of(raw, np.array([1, 2, 3, 2, 1])).tolist() == sum(times, [])
    out = token_counts.merged(np.array([7, 7, 9, 7, 8]), np.array([3, 1, 0, 3, 5], np.uint16), np.array([2, 10, 2**33, 5, 70_000]))
    kinds = {2: "<u2", 4: "<u4", 8: "<i8"}
    rows = [(b, np.frombuffer(p, "<u2").tolist(), np.frombuffer(s, kinds[2 * len(s) // len(p)]).tolist()) for b, p, s in zip(out["block"], out["places"], out["sums"], strict=True)]
    assert rows == [(7, [1, 3], [10, 7]), (8, [5], [70_000]), (9, [0], [2**33])]


def full_scan(rows, k):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in vectors:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # many shards and pages
        monkeypatch.setattr(mtree, "SHARD_ROWS", 20)
        monkeypatch.setattr(mtree, "PAGE", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(150)]  # one common vector, ties
    rows += [(600, None), (650, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (None, [0.1] * 8), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (850, []), (851, []), (900, [1e12] * 8), (50, [0.1] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = mtree.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    want = full_scan(rows, 5)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, n, i, clip(s)) for q, n, i, s in want}
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_in_rounds_holds_k_rows_a_query_and_task(spark, monkeypatch):
    """Many shards, none of which can be skipped: a task's rows for a query don't grow with the shards that it visits."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 10)
    monkeypatch.setattr(mtree, "ROUND", 2000)
    tables = []
    monkeypatch.setattr(mtree, "cut", lambda df, name="table": tables.append((name, cut(df, name))) or tables[-1][1])
    rng = np.random.default_rng(4)
    rows = [(i, (rng.random(16) * 2 - 1).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mtree.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == set(full_scan(rows, 5))
    others = [t for name, t in tables if name == "others"]
    assert len(others) > 1
    for t in others:
        assert all(r["count"] <= 5 for r in t.groupBy("query_id", F.input_file_name()).count().collect())
