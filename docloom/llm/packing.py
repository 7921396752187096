"""Packing of tokenised documents into sequences by length patterns.

Documents become pieces of at most ``capacity`` tokens. The pieces' length histogram has ``capacity`` bins at any size
of the corpus, so the plan is made on the driver: all patterns of up to three lengths that fill a sequence are
enumerated, non-negative least squares fits how often each repeats, the counts are rounded down to whole ones within
the histogram, and best-fit packs the residual lengths. The plan is a list of intervals "pieces number lo.. of length
L lie in sequences s.. at offset o". Pieces are numbered within their length by counting per bucket, of which there are
more the more pieces there are, so a length that most pieces share is dealt over many tasks, and each looks its place up.

Defined results: a null text is an empty document, one piece that holds only the end token. Rows are separate
documents even where doc_ids repeat or are null. Other columns, whatever their names, don't matter and aren't returned. A
very long text, of whatever characters, is held, with its ids, in the task that reads it. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.storage import cut

#: Buckets of each length at least, and pieces of all lengths for each one beyond.
BUCKETS, BUCKET_PIECES = 256, 1_000_000
#: Up to here the two libraries' letter, number and space classes agree, and so do their ids.
PLAIN = "\u024f"


class Ids:
    """Ids of the ``tokenizers`` file. Texts of plain Latin characters go through tiktoken's copy of the vocabulary,
    which is faster and gives the same ids there; all others, those with a special token's string, and those with more
    white space in a row than the copy can take, do not."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if (text.isascii() or max(text) <= PLAIN) and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # its pattern has a stack, which a million characters of white space overflow
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(docs: DataFrame, ids: dict[str, str], end_id: int, capacity: int) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32), a row per piece; ``row`` tells apart rows with one doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Ids(**ids)
        for b in batches:
            out = []
            for row, doc, text in zip(b["row"].tolist(), b["doc_id"], b["text"], strict=True):
                own = np.append(of(text), np.uint32(end_id)).astype("<u4") if text else np.array([end_id], "<u4")
                first = len(own) % capacity or min(capacity, len(own))
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((row, doc, k, lo, hi - lo, zlib.crc32(own[lo:hi].tobytes())))
            yield pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "row long, doc_id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def patterns(capacity: int) -> np.ndarray:
    """All multisets of one to three lengths that sum to ``capacity``, longest first; 0 for none."""
    out = [np.array([[capacity, 0, 0]])]
    for a in range(capacity - 1, (capacity + 2) // 3 - 1, -1):
        b = np.arange(min(a, capacity - a), (capacity - a + 1) // 2 - 1, -1)
        c = capacity - a - b
        out.append(np.stack([np.full_like(b, a), b, c], axis=1)[b >= c])
    return np.concatenate(out)


def fit(histogram: np.ndarray, pats: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in least squares.

    Accelerated projected gradient; the patterns' matrix is only ever read through their three lengths. Lengths are
    weighted by themselves, as a long piece left over costs more than a short one.
    """
    capacity = len(histogram) - 1
    weight = np.sqrt(np.arange(capacity + 1) / capacity)
    weight[0] = 0
    apply = lambda x: np.bincount(pats.ravel(), np.repeat(x, 3), capacity + 1) * weight
    back = lambda r: (r * weight)[pats].sum(axis=1)
    target, v = histogram * weight, np.ones(len(pats))
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(apply(v / np.linalg.norm(v)))
    step = 1 / (np.linalg.norm(v) * 1.02)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - target))
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / faster * (new - x), new, faster
    return x


def rounded(x: np.ndarray, pats: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts within the histogram, most repeated patterns first, and the residual histogram."""
    left, counts = histogram.copy(), np.zeros(len(pats), np.int64)
    for p in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[p] + 0.5))
        if want <= 0:
            break
        lengths, need = np.unique(pats[p][pats[p] > 0], return_counts=True)
        counts[p] = min(want, *(left[lengths] // need).tolist())
        left[lengths] -= counts[p] * need
    return counts, left


@dataclass
class Plan:
    """Intervals sorted by (length, lo); a piece is found by searching its length and number."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def at(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 48) | number
        i = np.searchsorted(self.key, key, side="right") - 1
        return self.sequence[i] + (key - self.key[i]), self.offset[i]


def plan(histogram: np.ndarray) -> Plan:
    """Where each (length, number) lies. ``histogram[L]`` pieces have length L."""
    capacity = len(histogram) - 1
    pats = patterns(capacity)
    counts, left = rounded(fit(histogram, pats), pats, histogram)
    used, rows, n = np.zeros(capacity + 1, np.int64), [], 0

    def lay(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append(((int(length) << 48) | int(used[length]), sequence, offset))
        used[length] += count

    for p in np.flatnonzero(counts):
        offset = 0
        for length in pats[p][pats[p] > 0]:
            lay(length, counts[p], n, offset)
            offset += int(length)
        n += int(counts[p])
    # Best-fit decreasing on counts: bins with one room left are runs of sequences, so a step lays many pieces.
    rooms: dict[int, list[tuple[int, int]]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        for room in range(length, capacity + 1):
            while todo and rooms.get(room):
                first, many = rooms[room].pop()
                taken = min(many, todo)
                lay(length, taken, first, capacity - room)
                if taken < many:
                    rooms[room].append((first + taken, many - taken))
                rooms.setdefault(room - length, []).append((first, taken))
                todo -= taken
            if not todo:
                break
        while todo:  # new sequences, each filled with as many of this length as fit
            each = min(capacity // length, todo)
            many = todo // each
            for k in range(each):
                lay(length, many, n, k * length)
            rooms.setdefault(capacity - each * length, []).append((n, many))
            n += many
            todo -= many * each
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], n)


def pack(docs: DataFrame, ids: dict[str, str], end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    pieces = cut(token_pieces(docs, ids, end_id, capacity), "pieces")
    buckets = max(BUCKETS, pieces.count() // BUCKET_PIECES)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    sent = docs.sparkSession.sparkContext.broadcast(plan(histogram))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    numbered = pieces.withColumn("number", F.row_number().over(own) - 1).join(first, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("first"))

    @F.pandas_udf("sequence long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = sent.value.at(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence": sequence, "offset": offset})

    out = numbered.withColumn("at", placed("length", "number"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence").alias("sequence_id"), F.col("at.offset").alias("offset"))
