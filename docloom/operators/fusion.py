"""Rank fusion, keyword coverage, re-ranking and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.pairs import PairScorer

K, BOOST, DEFAULT = 60, 10.0, 1.0


def reciprocal_rank_fusion(lists: DataFrame, limit: int = 0) -> DataFrame:
    """(doc_id, original_score, rrf_score, final_score) from (list_id, doc_id, score)."""
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "doc_id"))
    merged = lists.withColumn("r", rank).groupBy("doc_id").agg(F.max("score").alias("original_score"), F.round(F.sum(F.lit(1.0) / (F.col("r") + K)), 10).alias("rrf_score"))
    out = merged.withColumn("final_score", F.round(F.col("original_score") * (1 + BOOST * F.col("rrf_score")), 6))
    return out.orderBy(F.desc("final_score"), "doc_id").limit(limit) if limit else out


def attach_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``docs`` (id) with final_score from ``scores`` (doc_id), 1.0 where it has none."""
    return docs.join(scores.select(F.col("doc_id").alias("id"), "final_score"), "id", "left").withColumn("final_score", F.coalesce("final_score", F.lit(DEFAULT)))


def coverage(text: Column, keywords: list[str]) -> Column:
    """Share of keywords that the text contains literally; 1 without keywords."""
    if not keywords:
        return F.lit(1.0)
    return sum(F.contains(F.lower(text), F.lit(k.lower())).cast("int") for k in keywords) / F.lit(float(len(keywords)))


def adjust_by_keywords(docs: DataFrame, text: Column, keywords: list[str]) -> DataFrame:
    out = docs.withColumn("final_score", F.round(F.col("final_score") * coverage(text, keywords), 6))
    return out.filter("final_score > 0") if keywords else out


def ranked(docs: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    best = docs.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), key)))


def overlap_score(query: Column, passage: Column) -> Column:
    """Sigmoid of how many of the query's words the passage holds: a stand-in where no pair model is installed."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q = words(query)
    share = F.size(F.array_intersect(q, words(passage))) / F.greatest(F.size(q), F.lit(1))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(2.0) - F.lit(4.0) * share)), 6)


def rerank(docs: DataFrame, query: Column, text: Column, limit: int, mode: str = "by_id", content: str = "content", scorer: PairScorer | None = None) -> DataFrame:
    """The best by pair score: the scorer's, or the overlap of words without one.

    ``compat`` scores distinct passages, takes the best, and only then goes back to rows by their text: of a passage's
    rows the one with the lowest id stays, and a passage that is no row's ``content`` (a parent's text) is lost.
    """
    if scorer is None:
        scored = lambda rows, passage: rows.withColumn("rerank_score", overlap_score(query, passage))
    else:
        scored = lambda rows, passage: scorer.score(rows.withColumns({"_q": query, "_p": passage}), "_q", "_p").drop("_q", "_p")
    if mode != "compat":
        return ranked(scored(docs, text), "rerank_score", "id", limit)
    passages = scored(docs.select(text.alias("_passage")).distinct(), F.col("_passage"))
    best = passages.orderBy(F.desc("rerank_score"), "_passage").limit(limit)
    back = docs.join(F.broadcast(best), F.col(content) == F.col("_passage"))  # as many rows as asked for
    first = back.withColumn("n", F.row_number().over(Window.partitionBy("_passage").orderBy("id"))).filter("n = 1").drop("n", "_passage")
    return ranked(first, "rerank_score", "id", limit)


def context(ranked_docs: DataFrame, text: str = "ctx") -> DataFrame:
    """One row: distinct texts in rank order, numbered. The input is a ranked top-k, so it is small by definition."""
    first = ranked_docs.groupBy(text).agg(F.min("rank").alias("rank"))
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("rank")))
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col(text), F.lit("\n\n")).alias("t"))))
    return numbered.agg(F.array_join(F.transform(parts, lambda s: s["t"]), "").alias("context"))


# The rules that go before every question, and the parts of what the question is put into.
RULES = """你是一个智能助手，必须严格基于提供的参考资料回答用户问题。

重要规则：
1. 只能使用参考资料中的信息，不得编造或添加资料中没有的内容
2. 如果参考资料中没有相关信息，明确告知用户"知识库中没有找到相关信息"
3. 回答时要引用参考资料的具体内容，保持准确性
4. 不要使用你自己的训练知识，只使用提供的参考资料
"""


ASKED, GIVEN, TASK = "问题：", "\n\n参考资料：\n", "\n请基于以上参考资料回答问题：\n"


def prompt(question: str, ctx: DataFrame, generate: Column | None = None) -> DataFrame:
    """(system, prompt) for a question and its context; with ``generate``, also the answer that this column (a model's
    function of system and prompt) gives."""
    out = ctx.select(F.lit(RULES).alias("system"), F.concat(F.lit(ASKED + question + GIVEN), F.col("context"), F.lit(TASK)).alias("prompt"))
    return out if generate is None else out.withColumn("answer", generate)
