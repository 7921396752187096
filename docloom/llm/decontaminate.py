"""Passages of a benchmark in documents, found by Wu-Manber search over words.

Each window of ``window`` consecutive words of an item, and the whole of a shorter item, is a pattern; patterns of one
length share their tables. The search looks at the last block of words that a pattern could end with: a shift table says
how far the next possible end is; where that is 0, the block's bucket and the hash of the words before it select
patterns, which are compared word by word. Many positions of a batch of texts, one per lane, move on together.

Words are runs of ASCII letters (A-Z lower-cased), digits and any character beyond ASCII. A text is read once, where it
lies, and nothing is shuffled. The benchmark may be of any size: its items are cut into pieces that overlap by a
window less one word, pieces are dealt to blocks of about ``block_bytes``, and each block is searched for in all documents; only
what the blocks found meets.

Defined results: a null or empty text, or one without words, has no words and is not contaminated; such an item has no
pattern. Items with one id are one item; an item with a null id marks words, but is not named. Repeated rows, and rows
that share a doc_id, are documents of their own. Other columns pass through; those named like new ones are replaced.
Very long texts are turned into word numbers in slices. An empty table of documents gives an empty table, an empty
benchmark marks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import add_columns, without
from docloom.storage import cut

WINDOW = 10
#: Bytes of text that are split at once, and bytes of documents that are searched together.
SLICE, BATCH = 1 << 20, 4 << 20
#: Windows of an item that lie in one piece, and bytes of pieces in a block.
PIECE, BLOCK = 4096, 8 << 20
#: Ends of windows that a lane looks through.
LANE = 512
WORD_BYTES = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
FOLD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def word_runs(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; a slice ends between two words."""
    clean, at = (raw or b"").translate(WORD_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


class Patterns:
    """Shift table and buckets of distinct patterns of ``m`` words, given as rows of word numbers above 0."""

    def __init__(self, rows: np.ndarray):
        n, self.m = rows.shape
        self.block = min(2, self.m)
        self.bits = np.uint64(min(24, max(10, int(4 * n).bit_length())))
        self.shift = np.full(1 << int(self.bits), self.m - self.block + 1, np.uint8)
        for last in range(self.block - 1, self.m):  # the later a block, the shorter its shift
            self.shift[self.bucket(rows, np.full(n, last))] = self.m - 1 - last
        keys = self.key(rows)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[self.order], rows[self.order]

    def bucket(self, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
        own = np.arange(len(rows))
        return self.hashed([rows[own, last - k] for k in range(self.block)])

    def hashed(self, words: list[np.ndarray]) -> np.ndarray:
        """Number of a block, given by its words from the last one back."""
        code = words[0].astype(np.uint64)
        for w in words[1:]:
            code = code * FOLD + w.astype(np.uint64)
        return (code * SPREAD) >> (np.uint64(64) - self.bits)

    def key(self, rows: np.ndarray) -> np.ndarray:
        """Bucket of the last block above, hash of the words before it below."""
        code = np.zeros(len(rows), np.uint64)
        for k in range(self.m - self.block):
            code = (code ^ rows[:, k].astype(np.uint64)) * FOLD
            code ^= code >> np.uint64(29)
        return (self.bucket(rows, np.full(len(rows), self.m - 1)) << (np.uint64(64) - self.bits)) | ((code * SPREAD) >> self.bits)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of occurrences in ``ids`` and which pattern each is."""
        at = np.arange(self.m - 1, len(ids), LANE)
        stop, ends = np.minimum(at + LANE, len(ids)), [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[self.hashed([ids[at - k] for k in range(self.block)])]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        ends = np.sort(np.concatenate(ends))
        found = [self.compared(ids, ends[lo : lo + 65536]) for lo in range(0, len(ends), 65536)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (ends, ends)

    def compared(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = ids[ends[:, None] + np.arange(1 - self.m, 1)]
        keys = self.key(rows)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = []
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # patterns of one key are tried one after the other
            same = (self.rows[lo[open_]] == rows[open_]).all(axis=1)
            out.append((ends[open_[same]], self.order[lo[open_[same]]]))
            lo[open_] += 1
            open_ = open_[~same]
            open_ = open_[lo[open_] < hi[open_]]
        return (np.concatenate([e for e, _ in out]), np.concatenate([w for _, w in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Searcher:
    """All patterns of some pieces (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int):
        split = [(item, words.split()) for item, words in pieces]
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, words in split for w in words))}
        self.items = sorted({item for item, _ in split if item is not None})
        at, by_length = {item: i for i, item in enumerate(self.items)}, {}
        for item, words in split:
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            m = min(window, len(ids))
            rows = np.lib.stride_tricks.sliding_window_view(ids, m)
            by_length.setdefault(m, []).append((rows, np.full(len(rows), at.get(item, -1))))
        self.patterns = []  # with, for each pattern, where its items begin, and the items
        for _, parts in sorted(by_length.items()):
            rows, owner = np.concatenate([r for r, _ in parts]), np.concatenate([o for _, o in parts])
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner], axis=1)[owner >= 0], axis=0)
            self.patterns.append((Patterns(rows), np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))

    def ids(self, raw: bytes | None) -> np.ndarray:
        """Numbers of a text's words, 0 for words of no pattern, and a 0 behind the last."""
        get = self.number.get
        return np.concatenate([*[np.fromiter((get(w, 0) for w in run), np.int32, len(run)) for run in word_runs(raw)], np.zeros(1, np.int32)])

    def __call__(self, texts: list[bytes | None]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        """Of each text the number of words, spans of hit words and the items found."""
        own = [self.ids(t) for t in texts]
        starts = np.cumsum([0, *map(len, own)])
        ids = np.concatenate([np.zeros(0, np.int32), *own])
        edge, found = np.zeros(len(ids) + 1, np.int32), {}
        for patterns, first, items in self.patterns:
            ends, which = patterns.search(ids)
            np.add.at(edge, ends - patterns.m + 1, 1)
            np.add.at(edge, ends + 1, -1)
            met = np.unique(np.stack([np.searchsorted(starts, ends, "right") - 1, which], axis=1), axis=0)
            for doc, w in met.tolist():
                found.setdefault(doc, set()).update(items[first[w] : first[w + 1]].tolist())
        hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        spans = [[] for _ in texts]
        for doc, b, e in zip((np.searchsorted(starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            spans[doc].append({"begin": b - int(starts[doc]), "end": e - int(starts[doc])})
        return [len(x) - 1 for x in own], spans, [[self.items[i] for i in sorted(found.get(d, ()))] for d in range(len(texts))]


def pieces_of(benchmark: DataFrame, window: int, size: int) -> DataFrame:
    """(item, words): at most ``size`` windows of an item each, so that each window lies in a piece whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                held, cut_off = [], False
                for words in word_runs(raw):
                    held += words
                    while len(held) >= size + window:
                        yield pa.RecordBatch.from_pydict({"item": [item], "words": [b" ".join(held[: size + window - 1])]}, schema)
                        held, cut_off = held[size:], True
                if len(held) >= (window if cut_off else 1):
                    yield pa.RecordBatch.from_pydict({"item": [item], "words": [b" ".join(held)]}, schema)

    schema = pa.schema([("item", pa.string()), ("words", pa.binary())])
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item string, words binary").distinct()


def blocks_of(pieces: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``pieces`` with the block each is dealt to, and the number of blocks: as many as keep the largest one small."""
    sizes = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.coalesce(F.max(F.octet_length("words")), F.lit(0))).first()
    n = max(1, math.ceil(sizes[0] / block_bytes))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        if n == 1 or dealt.groupBy("block").agg(F.sum(F.octet_length("words")).alias("n")).agg(F.max("n")).first()[0] <= 2 * block_bytes + sizes[1]:
            return dealt, n
        n *= 2


def searched(docs: DataFrame, searcher: Searcher) -> DataFrame:
    """``docs`` with n_words, spans and items of one block of patterns."""

    def start():
        def of(b: pa.RecordBatch) -> dict:
            texts, out, lo = b.column("text").cast(pa.binary()).to_pylist(), ([], [], []), 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi] or b"") <= BATCH):
                    held += len(texts[hi] or b"")
                    hi += 1
                with np.errstate(over="ignore"):
                    for made, new in zip(out, searcher(texts[lo:hi]), strict=True):
                        made += new
                lo = hi
            return {"n_words": out[0], "spans": out[1], "items": out[2]}

        return of

    return add_columns(docs, [("n_words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType()))], start)


def united(df: DataFrame) -> DataFrame:
    """``df`` with the spans of several blocks made one list without overlap."""

    def of(b: pa.RecordBatch) -> dict:
        out = []
        for own in b.column("spans").to_pylist():
            begin = np.array([s["begin"] for s in own], np.int64)
            end = np.array([s["end"] for s in own], np.int64)
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), begin[1:] > reach[:-1]]))
            out.append([{"begin": int(begin[i]), "end": int(e)} for i, e in zip(first, reach[np.concatenate([first[1:] - 1, [len(own) - 1]])] if len(own) else [], strict=True)])
        return {"spans": out}

    return add_columns(df, [("spans", SPANS)], lambda: of)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``docs`` (text) with n_words, spans (begin and end, exclusive, in words) that items of ``benchmark`` (item_id, text)
    cover, and items, the found items' ids as sorted strings."""
    dealt, n = blocks_of(cut(pieces_of(benchmark, window, piece), "pieces"), block_bytes)
    searcher = lambda k: Searcher([(r["item"], bytes(r["words"])) for r in dealt.filter(F.col("block") == k).select("item", "words").collect()], window)
    docs = without(docs, ["n_words", "spans", "items"])
    if n == 1:
        return searched(docs, searcher(0))
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    texts = rows.select("_row", "text")
    parts = [cut(searched(texts, searcher(k)).drop("text").filter((F.size("spans") > 0) | F.lit(k == 0)), "found") for k in range(n)]
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    met = met.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    met = united(met.withColumn("items", F.array_sort(F.array_distinct("items"))))
    return rows.join(met, "_row").drop("_row")
