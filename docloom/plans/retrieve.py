"""The retrieval query: rewrite, two vector searches and one keyword search, fusion, coverage, top-k, context."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import fusion, search
from docloom.operators.graph import GraphIndex
from docloom.operators.index import VectorIndex
from docloom.operators.pairs import PairScorer
from docloom.operators.postings import KeywordIndex


@dataclass
class Retriever:
    """``chunks`` (id, content, parent_content) and ``vectors`` (doc_id, embedding). With an index of either, searches go
    through it: the keyword index gives the same rows, a vector index nearly all of them."""

    chunks: DataFrame
    vectors: DataFrame
    top_k: int = 20
    threshold: float = 0.5
    rerank_top_k: int = 50
    keyword_index: KeywordIndex | None = None
    vector_index: GraphIndex | VectorIndex | None = None
    pair_scorer: PairScorer | None = None

    def keywords(self, question: str) -> list[str]:
        q = F.lit(question)
        return self.chunks.sparkSession.range(1).select(text.core_keywords(text.rewrite(q)).alias("k")).first()["k"]

    def nearest(self, query_vectors: list[list[float]], k: int, deleted: DataFrame | None) -> DataFrame:
        """(list_id, doc_id, score): the k best for each of a question's vectors, in one pass for all of them."""
        if self.vector_index is not None:
            spark = self.vectors.sparkSession
            asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(query_vectors)], "query_id long, embedding array<double>")
            found = self.vector_index.search(spark, asked, k, self.threshold, deleted=deleted)
        else:
            live = self.vectors if deleted is None else self.vectors.join(deleted, "doc_id", "left_anti")
            found = search.best_ranks(search.block_top_k(live, np.arange(len(query_vectors)), np.array(query_vectors, float), k, self.threshold), k)
        return found.select(F.col("query_id").cast("int").alias("list_id"), "doc_id", "score")

    def search(self, question: str, query_vectors: list[list[float]], deleted: DataFrame | None = None, reranking: bool = False) -> DataFrame:
        """Ranked chunks; an empty list of vectors leaves the keyword search alone."""
        k = self.rerank_top_k if reranking else self.top_k
        words = self.keywords(question)
        if self.keyword_index is not None:
            hits = self.keyword_index.hits(self.chunks.sparkSession, words[:10], 2 * k)
        else:
            hits = search.keyword_hits(self.chunks, words[:10], 2 * k)
        lists = [hits.select(F.lit(len(query_vectors)).alias("list_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))]
        if query_vectors:
            lists.append(self.nearest(query_vectors, k, deleted))
        fused = fusion.reciprocal_rank_fusion(reduce(DataFrame.unionByName, lists))
        docs = self.chunks.join(F.broadcast(fused.withColumnRenamed("doc_id", "id")), "id")  # at most 4 k fused rows
        ctx = F.coalesce("parent_content", "content")
        adjusted = fusion.adjust_by_keywords(docs, ctx, words).withColumn("ctx", ctx)
        return fusion.rerank(adjusted, F.lit(question), F.col("ctx"), self.top_k, scorer=self.pair_scorer) if reranking else fusion.ranked(adjusted, "final_score", "id", self.top_k)

    def context(self, question: str, query_vectors: list[list[float]]) -> DataFrame:
        return fusion.context(self.search(question, query_vectors))
