"""A lexicon of Chinese words learned from texts, and the best way to cut a text into its words.

Substrings of up to LONGEST Chinese characters are counted with the characters before and behind them. A word is one of
two or more characters that is frequent, holds together (wherever it could be cut in two, it is more frequent than its
parts' frequencies would make it, by a factor of at least e^cohesion) and stands free (the entropy of the characters before
it, and of those behind it, is at least ``freedom``; each end of a run of Chinese characters counts as a character of its
own). Counts are summed per task before they move; one shuffle then brings a substring's counts together, and the
frequent ones meet the frequencies of their parts by joins.

A text is cut so that the product of its words' shares of all characters is greatest, of equal ways the one with the longer
first word. A character of no word stands alone, with the share of half an occurrence. Latin words are words, as in
``text.segments``; everything else separates.

Defined results: null texts teach nothing and have no words; repeated rows count each. An empty table, or one without
Chinese characters, makes an empty lexicon, by which each character stands alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text

LONGEST = 4
#: Characters that a task counts at once; words that a lexicon holds, the most frequent ones.
HELD, WORDS = 1 << 20, 200_000
FIRST, LAST, BITS = 0x4E00, 0x9FA5, 15
PARTS = re.compile("([a-z0-9][a-z0-9_.+#@&-]*)|([一-龥]+)")
COUNTS = "gram string, side int, beside int, n long"


def runs_of(texts: list[str]) -> np.ndarray:
    """The Chinese characters of some texts, numbered from 1 on, with one 0 for all that is between two runs."""
    codes = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), 0) for t in ["", *texts]])
    codes = np.where((codes >= FIRST) & (codes <= LAST), codes - FIRST + 1, 0)
    return codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]


def counted(codes: np.ndarray, longest: int) -> pd.DataFrame:
    """How often each substring has which character before it (side 0) and behind it (1); ``codes`` begin and end with 0."""
    out = [pd.DataFrame({"gram": [], "side": [], "beside": [], "n": []})]
    for size in range(1, longest + 1):
        n = len(codes) - size - 1
        if n < 1:
            break
        parts = [codes[1 + k : 1 + k + n] for k in range(size)]
        whole = np.all([p > 0 for p in parts], axis=0)
        gram = sum((p[whole] << (BITS * k) for k, p in enumerate(parts)), np.zeros(int(whole.sum()), np.int64))
        known, number = np.unique(gram, return_inverse=True)
        letters = [((known >> (BITS * k)) & ((1 << BITS) - 1)) + FIRST - 1 for k in range(size)]
        spelled = np.array(["".join(map(chr, x)) for x in zip(*[c.tolist() for c in letters], strict=True)], object)
        for side, beside in ((0, codes[:n][whole]), (1, codes[size + 1 : size + 1 + n][whole])):
            pairs, times = np.unique((number.ravel() << BITS) | beside, return_counts=True)
            out.append(pd.DataFrame({"gram": spelled[pairs >> BITS], "side": side, "beside": pairs & ((1 << BITS) - 1), "n": times}))
    return pd.concat(out)


def learn(texts: DataFrame, column: str = "text", longest: int = LONGEST, least: int = 5, cohesion: float = 2.0, freedom: float = 1.0) -> DataFrame:
    """(word, n, share, cohesion, freedom) of the words of ``texts``; ``share`` is of all Chinese characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for t in b["text"].tolist():
                held.append(t)
                size += len(t)
                if size > HELD:
                    yield counted(runs_of(held), longest)
                    held, size = [], 0
            yield counted(runs_of(held), longest)

    rows = texts.select(F.col(column).alias("text")).filter(F.col("text").rlike("[一-龥]")).mapInPandas(run, COUNTS)
    # Dealt by substring, so that its neighbours' counts and its own are summed after one shuffle.
    beside = rows.repartition("gram").groupBy("gram", "side", "beside").agg(F.sum("n").alias("n"))
    spread = lambda side: F.sum(F.when((F.col("side") == side) & (F.col("beside") > 0), F.col("n") * F.log("n")).otherwise(0.0))
    own = beside.groupBy("gram").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n"), spread(0).alias("before"), spread(1).alias("behind"))
    own = own.withColumn("freedom", F.log("n") - F.greatest("before", "behind") / F.col("n")).select("gram", "n", "freedom")
    total = own.filter(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    frequent = own.filter(F.col("n") >= least)
    halves = frequent.filter(F.length("gram") > 1).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)))
    halves = halves.withColumn("a", F.expr("left(gram, at)")).withColumn("b", F.expr("substring(gram, at + 1)"))
    part = lambda name: frequent.select(F.col("gram").alias(name), F.col("n").alias(f"n{name}"))
    held = halves.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total))  # one row
    tight = F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))
    words = held.groupBy(F.col("gram").alias("word")).agg(F.first("n").alias("n"), F.first(F.col("n") / F.col("total")).alias("share"), F.min(tight).alias("cohesion"), F.first("freedom").alias("freedom"))
    return words.filter((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom))


@dataclass
class Lexicon:
    """Words with the logarithms of their shares, and that of a character alone."""

    words: dict[str, float]
    alone: float
    longest: int

    @classmethod
    def of(cls, learned: DataFrame, known: dict[str, float] | None = None, most: int = WORDS) -> Lexicon:
        """The ``most`` frequent words, and those of ``known`` with shares of their own."""
        rows = learned.select("word", "n", "share").orderBy(F.desc("n"), "word").limit(most).collect()
        words = {r["word"]: math.log(r["share"]) for r in rows} | {w: math.log(s) for w, s in (known or {}).items()}
        # The least of all is one occurrence.
        one = min([r["share"] / r["n"] for r in rows], default=1e-9)
        return cls(words, math.log(one / 2), max(map(len, words), default=1))

    def cut(self, run: str) -> list[str]:
        """The best cut of a run of Chinese characters, folded from its end."""
        best, step = [0.0] * (len(run) + 1), [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            best[i] = self.alone + best[i + 1]
            for n in range(2, min(self.longest, len(run) - i) + 1):
                share = self.words.get(run[i : i + n])
                if share is not None and share + best[i + n] >= best[i]:
                    best[i], step[i] = share + best[i + n], n
        out, at = [], 0
        while at < len(run):
            out.append(run[at : at + step[at]])
            at += step[at]
        return out

    def segments(self, c: Column) -> Column:
        """The words of a text, in lower case."""

        def words(t: str | None) -> list[str] | None:
            return None if t is None else [w for latin, run in PARTS.findall(t.lower()) for w in ([latin] if latin else self.cut(run))]

        return F.pandas_udf(lambda s: s.map(words), T.ArrayType(T.StringType()))(c)

    def core_keywords(self, c: Column) -> Column:
        """``text.core_keywords`` with these words in place of pairs of characters."""
        words = F.concat(self.segments(c), text.custom_terms(c))
        return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(text.STOP_WORDS)), F.lower))
