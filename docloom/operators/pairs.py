"""How well a passage answers a question: a scorer of pairs with the corpus's word statistics, fitted on labelled pairs.

Of a pair three shares are taken, each from 0 to 1: of the question's words, weighted by how rare they are, what BM25
gives and what the passage has at all; and of the question's pairs of neighbouring words, those that stand together in the
passage. The score is the logistic function of their weighted sum. The weights are fitted by logistic regression on at most
SAMPLE labelled pairs, taken by a hash of the pair; WEIGHTS are those of a corpus of prose in four languages.

Words are runs of letters and digits, in lower case; of a passage the first PASSAGE count, as a pair model reads no more, of
a question the first QUESTION different ones. Statistics are counted over all passages, so cut.

Defined results: a null or empty passage has no word and shares 0; a question without words has shares 0 with every
passage. A word that no passage has is the rarest. Repeated passages count each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE, QUESTION, SAMPLE = 512, 64, 20_000
K1, B = 1.2, 0.75
#: Of no share, then of the three.
WEIGHTS = (-6.0, 4.0, 8.0, 6.0)


def words(c: Column, most: int) -> Column:
    return F.slice(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, most)


def summed(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + of(x))


@dataclass
class Statistics:
    """``frequencies``: (word, n), in how many passages a word is; their number and mean length."""

    frequencies: DataFrame
    passages: int
    length: float

    @classmethod
    def of(cls, passages: Column, rows: DataFrame) -> Statistics:
        cut = rows.select(words(passages, PASSAGE).alias("w"))
        n, length = cut.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
        counts = cut.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return cls(counts, n, length or 1.0)

    def rarity(self, n: Column) -> Column:
        return F.log1p((self.passages - n + F.lit(0.5)) / (n + F.lit(0.5)))

    def asked(self, questions: DataFrame, question: str) -> DataFrame:
        """``questions`` with ``asked``: the different words of the question in their order, each with its rarity."""
        own = questions.select(question).distinct()
        parts = own.select(question, F.posexplode(F.slice(F.array_distinct(words(F.col(question), PASSAGE)), 1, QUESTION)).alias("i", "word"))
        met = parts.join(self.frequencies, "word", "left").withColumn("rarity", self.rarity(F.coalesce("n", F.lit(0))))
        lists = met.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("i", "word", "rarity"))).alias("asked"))
        return questions.join(lists, question, "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<i:int,word:string,rarity:double>>")))

    def shares(self, asked: Column, question: Column, passage: Column) -> Column:
        """The three shares, as an array."""
        held = words(passage, PASSAGE)
        size = F.size(held)
        times = lambda x: F.size(F.filter(held, lambda w: w == x["word"])).cast("double")
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / F.lit(self.length))
        weight = summed(asked, lambda x: x["rarity"])
        bm25 = summed(asked, lambda x: x["rarity"] * times(x) / (times(x) + norm)) / weight
        covered = summed(asked, lambda x: F.when(F.array_contains(held, x["word"]), x["rarity"]).otherwise(0.0)) / weight
        spaced = F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" "))
        ordered = words(question, QUESTION)
        pairs = F.array_distinct(F.zip_with(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, QUESTION), lambda a, b: F.concat(F.lit(" "), a, F.lit(" "), b, F.lit(" "))))
        near = F.size(F.filter(pairs, lambda p: F.contains(spaced, p))) / F.greatest(F.size(pairs), F.lit(1))
        return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in (F.when(weight > 0, bm25), F.when(weight > 0, covered), near)])


@dataclass
class PairScorer:
    statistics: Statistics
    weights: tuple[float, ...] = WEIGHTS

    @classmethod
    def fit(cls, statistics: Statistics, labelled: DataFrame) -> PairScorer:
        """Weights from ``labelled`` (question, passage, label 0 or 1)."""
        sample = labelled.filter("label is not null").withColumn("_h", F.xxhash64("question", "passage", "label")).orderBy("_h").limit(SAMPLE)
        rows = statistics.asked(sample, "question").select(F.col("label").cast("double").alias("label"), array_to_vector(statistics.shares(F.col("asked"), F.col("question"), F.col("passage"))).alias("features"))
        model = LogisticRegression(regParam=1e-4, standardization=False).fit(rows)
        return cls(statistics, (float(model.intercept), *map(float, model.coefficients)))

    def score(self, pairs: DataFrame, question: str = "question", passage: str = "passage", out: str = "rerank_score") -> DataFrame:
        """``pairs`` with the score of each."""
        rows = self.statistics.asked(pairs, question).withColumn("_shares", self.statistics.shares(F.col("asked"), F.col(question), F.col(passage)))
        total = sum((F.lit(w) * F.col("_shares")[i] for i, w in enumerate(self.weights[1:])), F.lit(self.weights[0]))
        return rows.withColumn(out, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)), 6)).drop("_shares", "asked")
