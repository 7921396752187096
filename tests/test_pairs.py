"""The pair scorer against a plain version, and on held-out pairs against the overlap of words."""

import math
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import fusion, pairs
from docloom.plans import queries as core

WORD = re.compile(r"[^\W_]+")


def plain(question, passage, passages, weights=pairs.WEIGHTS):
    cut = lambda t, n=pairs.PASSAGE: WORD.findall((t or "").lower())[:n]
    held = [cut(p) for p in passages]
    length = sum(map(len, held)) / len(held) or 1.0
    rarity = lambda w: math.log1p((len(held) - (n := sum(w in set(h) for h in held)) + 0.5) / (n + 0.5))
    asked, own = list(dict.fromkeys(cut(question)))[: pairs.QUESTION], cut(passage)
    total = sum(map(rarity, asked))
    norm = pairs.K1 * (1 - pairs.B + pairs.B * len(own) / length)
    bm25 = sum(rarity(w) * own.count(w) / (own.count(w) + norm) for w in asked) / total if total else 0.0
    covered = sum(rarity(w) for w in asked if w in own) / total if total else 0.0
    ordered = cut(question, pairs.QUESTION)
    wanted, there = set(zip(ordered, ordered[1:], strict=False)), set(zip(own, own[1:], strict=False))
    near = len(wanted & there) / max(1, len(wanted))
    return round(1 / (1 + math.exp(-(weights[0] + weights[1] * bm25 + weights[2] * covered + weights[3] * near))), 6)


PASSAGES = ["the cat sat on the mat", "The dog; the cat!", None, "", "a b c d e " * 120 + "cat", "Ünïcode 漢字 words 7", "cat cat cat"]
QUESTIONS = ["the cat on a mat", "", None, "absent words", "cat", "漢字 words", "cat cat sat"]


def test_score_equals_plain(spark):
    rows = spark.createDataFrame([(q, p) for q in QUESTIONS for p in PASSAGES], "question string, passage string")
    own = pairs.PairScorer(pairs.Statistics.of(F.col("p"), spark.createDataFrame([(p,) for p in PASSAGES], "p string")))
    got = {(r.question, r.passage): r.rerank_score for r in own.score(rows).collect()}
    for q in QUESTIONS:
        for p in PASSAGES:
            assert got[q, p] == pytest.approx(plain(q, p, PASSAGES), abs=2e-6), (q, p)


@pytest.fixture(scope="module")
def labelled(spark):
    """Questions of every third word from a document's second line on, with the document, and with another one of its
    language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 300 and lang is not null").select("doc_id", "lang", "text")
    asked = F.array_join(F.filter(pairs.words(F.substring("text", 120, 180), 60), lambda w, i: (i > 0) & (i % 3 < 2)), " ")
    first = F.lead("text").over(core.search.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id")))
    rows = docs.select("doc_id", asked.alias("question"), F.array(F.struct(F.lit(1).alias("label"), F.col("text").alias("passage")), F.struct(F.lit(0).alias("label"), first.alias("passage"))).alias("p"))
    return docs, rows.filter("p[1].passage is not null and p[1].passage <> p[0].passage").select("doc_id", "question", F.explode("p").alias("p")).select("doc_id", "question", "p.label", "p.passage").repartition(8).persist()


def right(scored):
    """Share of questions whose own document scores higher, ties counting half."""
    by = scored.groupBy("doc_id").pivot("label", [0, 1]).agg(F.first("s"))
    return by.agg(F.avg(F.when(F.col("1") > F.col("0"), 1.0).when(F.col("1") == F.col("0"), 0.5).otherwise(0.0))).first()[0]


def test_fitted_scorer_beats_overlap_on_held_out_pairs(spark, labelled):
    docs, rows = labelled
    known, held_out = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")
    stats = pairs.Statistics.of(F.col("text"), docs)
    fitted = pairs.PairScorer.fit(stats, known)
    ours = right(fitted.score(held_out, out="s"))
    plain_overlap = right(held_out.withColumn("s", fusion.overlap_score(F.col("question"), F.col("passage"))))
    assert ours > plain_overlap and ours >= 0.97, (ours, plain_overlap)
    assert all(w >= -1 for w in fitted.weights[1:]) and fitted.weights[0] < 0


def test_rerank_with_a_scorer(spark):
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(PASSAGES)], "id long, content string")
    own = pairs.PairScorer(pairs.Statistics.of(F.col("content"), docs))
    for mode in ("by_id", "compat"):
        out = fusion.rerank(docs, F.lit("the cat sat"), F.col("content"), 3, mode, scorer=own).orderBy("rank").collect()
        assert [r["rank"] for r in out] == [1, 2, 3] and out[0]["content"] == PASSAGES[0]
