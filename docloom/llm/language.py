"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMS bits, +1 or -1, drawn from its code point and the seed. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its
n-grams; a language's prototype bundles those of its training texts. A document gets the language whose prototype has
the largest cosine with its own vector.

Bundling is linear, so training counts n-grams per language over all labelled rows (one shuffle of counts, bounded by
languages x n-grams), binds each where its count lies, and adds whole numbers; only a vector per task and language
reaches the driver. The prototypes' common direction, which carries no information about the language, is removed by
subtracting the prototypes' mean before the cosine is taken. Bits of n-grams met before are kept, HELD of them at most.

Letters are lower-cased, each code point one of its own; all else is one break symbol. Defined results: a null text, or
one without a letter, is ``und`` with score 0; so is every text if nothing was learned, as from an empty table. Ties go
to the language first in order. Rows without a language or text teach nothing. More than MAX_LANGS distinct languages are
an error. Very long texts are counted in slices. Other columns, null ids and repeated rows pass through; input columns
named like the added ones are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import add_columns
from docloom.llm.perfect_hash import U, mix

DIMS, GRAM, SEED = 1024, 3, 7
#: N-grams whose bits a task keeps (32 MB); n-grams that are unpacked at once; code points of a text counted at once.
HELD, UNPACKED, SLICE = 1 << 18, 4096, 1 << 20
MAX_LANGS = 4096
UND = "und"


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point of the first plane, 0 where it is none."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Letters of a text, 0 for what lies between, with a break at both ends and no two breaks in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(codes) + 2, np.uint32)
    s[1:-1] = table[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        x = chr(codes[i])
        s[i + 1] = ord(x.lower()[0]) if x.isalpha() else 0
    return s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def grams(text: str, table: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes, 21 bits a letter, and their counts; none if the text has no letter."""
    s = symbols(text, table)
    if not s.any() or len(s) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    for lo in range(0, len(s) - n + 1, SLICE):
        part = s[lo : lo + SLICE + n - 1].astype(np.int64)
        code = np.zeros(len(part) - n + 1, np.int64)
        for k in range(n):
            code = code << 21 | part[k : len(part) - n + 1 + k]
        code.sort()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        found.append((code[first], np.diff(np.append(first, len(code)))))
    return found[0] if len(found) == 1 else summed(*map(np.concatenate, zip(*found, strict=True)))


class Binder:
    """Bundles of n-grams' vectors, bound from permuted letter vectors; +1 is a set bit, so binding is a xor."""

    def __init__(self, dims: int = DIMS, n: int = GRAM, seed: int = SEED, held: int = HELD):
        self.dims, self.n, self.seed, self.held, self.missed = dims, n, U(seed), held, 0
        self.clear()

    def clear(self) -> None:
        self.known, self.bits, self.missed = np.empty(0, np.int64), np.empty((0, self.dims // 8), np.uint8), 0

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The bits of each letter; the break's are as random as the others'."""
        words = self.dims // 64
        with np.errstate(over="ignore"):
            at = (codes.astype(np.uint64) + U(1))[:, None] * U(words) + np.arange(words, dtype=np.uint64)
            return mix(mix(at) ^ (self.seed * U(0x9E3779B97F4A7C15))).view(np.uint8)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        own, which = np.unique(np.stack([codes >> 21 * (self.n - 1 - k) & 0x1FFFFF for k in range(self.n)]), return_inverse=True)
        letters, which = self.letters(own), which.reshape(self.n, -1)
        out = np.zeros((len(codes), self.dims // 8), np.uint8)
        for k in range(self.n):
            out ^= np.roll(letters, self.n - 1 - k, axis=1)[which[k]]
        # A product of an odd number of factors has the sign of their xor, of an even number its opposite.
        return out if self.n % 2 else ~out

    def bits_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        new = self.known[at] != codes if len(self.known) else np.ones(len(codes), bool)
        if not new.any():
            return self.bits[at]
        made = self.bound(codes[new])
        out = np.empty((len(codes), self.dims // 8), np.uint8)
        out[~new], out[new] = self.bits[at[~new]], made
        self.missed += len(made)
        if len(self.known) + len(made) <= self.held:
            where = np.searchsorted(self.known, codes[new])
            self.known, self.bits = np.insert(self.known, where, codes[new]), np.insert(self.bits, where, made, axis=0)
        elif self.missed > 2 * self.held:  # other n-grams than those kept are the common ones now
            self.clear()
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of sorted distinct codes, each ``counts`` times; whole numbers."""
        total = np.zeros(self.dims)
        for lo in range(0, len(codes), UNPACKED):
            own = counts[lo : lo + UNPACKED]
            # Sums of whole numbers below 2^24 are exact in single precision.
            kind = np.float32 if own.sum() < 1 << 24 else np.float64
            set_ = own.astype(kind) @ np.unpackbits(self.bits_of(codes[lo : lo + UNPACKED]), axis=1).astype(kind)
            total += 2 * set_.astype(np.float64) - own.sum()
        return total


def gram_counts(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """(lang, gram, n) over the rows that have a language and a text, combined in each batch before the shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = letter_table()
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                found, held = [], 0
                for text in texts:
                    found.append(grams(text, table, n))
                    held += len(found[-1][0])
                    if held > HELD:
                        found, held = [summed(*map(np.concatenate, zip(*found, strict=True)))], 0
                codes, counts = summed(*map(np.concatenate, zip(*found, strict=True)))
                yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})

    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    return rows.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, dims: int = DIMS, n: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes. A task sums the vectors of its share of the counts, a vector a language;
    those of all tasks are added up before they reach the driver."""

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        binder, sums, totals = Binder(dims, n, seed), {}, {}
        for b in batches:
            b = b.sort_values("gram")
            for lang, own in b.groupby("lang", sort=False):
                codes, counts = summed(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
                sums[lang] = sums.get(lang, 0) + binder.bundle(codes, counts)
                totals[lang] = totals.get(lang, 0) + int(counts.sum())
        if sums:
            yield pd.DataFrame({"lang": list(sums), "total": list(totals.values()), "sums": [np.rint(x).astype(np.int64) for x in sums.values()]})

    parts = gram_counts(docs, n).mapInPandas(bundled, "lang string, total long, sums array<long>")
    whole = parts.select("lang", "total", F.posexplode("sums").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("total").alias("total"), F.sum("x").alias("x"))
    rows = whole.groupBy("lang").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("sums")).limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows.sort(key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows]
    protos = np.array([[x["x"] for x in r["sums"]] for r in rows], float).reshape(len(rows), dims) / np.array([[r["total"]] for r in rows], float).reshape(-1, 1)
    return langs, protos


def prepared(protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prototypes' mean and the centred prototypes of length 1; one language alone isn't centred."""
    mean = protos.mean(axis=0) if len(protos) > 1 else np.zeros(protos.shape[1])
    centred = protos - mean
    return mean, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], n: int = GRAM, seed: int = SEED) -> DataFrame:
    """``docs`` with lang_pred and score, the cosine (0 if negative) of the document with that language's prototype."""
    langs, protos = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, *prepared(protos))) if langs else None

    def start():
        table = letter_table()
        if sent:
            names_, mean, unit = sent.value
            binder = Binder(unit.shape[1], n, seed)

        def of(b: pa.RecordBatch) -> dict:
            names, scores = [], []
            for text in b.column("text").to_pylist():
                codes, counts = grams(text or "", table, n)
                if not len(codes) or not sent:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                own = binder.bundle(codes, counts) / counts.sum() - mean
                cosine = unit @ own / max(np.linalg.norm(own), 1e-12)
                k = int(np.argmax(cosine))
                names.append(names_[k])
                scores.append(float(min(1.0, max(0.0, cosine[k]))))
            return {"lang_pred": names, "score": scores}

        return of

    return add_columns(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], start)
