"""Token counts without token ids: pieces are counted once per distinct pre-token.

A block of documents becomes pre-token frequencies: a row per block and pre-token, with the documents that hold it and
how often. Those rows meet by pre-token; the first row of a pre-token has its pieces counted by the library, and the
count goes to all its rows, which lie next to it. What comes out is summed per document before it moves on, for as many
postings as a task holds: what travels back is never more than a sum per posting, however many tasks and blocks there
are.

Pre-tokens that more than HOT_SHARE of a block's documents hold are counted within the block, once a task: they would
make the longest lists and all meet in one task.

Texts of plain Latin characters are split here by the rules of the tokenizer file; all others, and those that hold a
special token's string, are split by the library itself. Defined results: a null text is empty and has no tokens. Each
row is a document of its own, whatever its doc_id, and repeated rows are counted each. Other columns, whatever their
names, don't matter and aren't returned. A very long text is held, with its pre-tokens, in the task that reads it. An empty
table gives an empty table.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PLAIN = "ɏ"
HOT_SHARE = 0.02
BLOCK = 2000
#: Postings (a document and a pre-token) that a task holds at once.
HELD = 2_000_000
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+")


class Splitter:
    """Pre-tokens of a text, as strings that the library splits no further."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.byte_of = {c: b for b, c in byte_letters().items()}

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens."""
        if not any(s in text for s in self.special):
            if text.isascii():
                return ASCII.findall(text.lower()), 0
            if max(text) <= PLAIN and "İ" not in text:
                return LATIN.findall(unicodedata.normalize("NFC", text).lower()), 0
        out, n = [], 0
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                n += 1
            elif part:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(self.byte_of[c] for c in p).decode() for p, _ in pieces]
        return out, n

    def count(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token, a few at a time, as the library returns much more than the number."""
        return [len(e) for at in range(0, len(pretokens), 1000) for e in self.library.encode_batch_fast(pretokens[at : at + 1000], add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One per Python worker. The library's own threads would each hold memory besides the task's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Splitter(path)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


FREQUENCIES = "block long, pretoken string, places binary, times binary"


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Per block and pre-token, the places of documents in the block and the frequencies there.

    A row without pre-token carries the block's documents themselves: what is already known of each one's sum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, known = splitter(path), {}
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.iloc[at : at + BLOCK]
                own, sums = {}, np.zeros(len(b), np.int64)  # of each pre-token: place, times, place, times ...
                for i, text in enumerate(b["text"]):
                    words, sums[i] = split(text or "")
                    for w, n in Counter(words).items():
                        if w in own:
                            own[w] += (i, n)
                        else:
                            own[w] = [i, n]
                hot = [w for w, x in own.items() if len(x) > 2 * max(20, HOT_SHARE * len(b))]
                new = [w for w in hot if w not in known]
                known.update(zip(new, split.count(new), strict=True))
                for w in hot:
                    x = np.array(own.pop(w))
                    sums[x[::2]] += x[1::2] * known[w]
                block = int(b["row"].iloc[0])
                names = [None if x is None else int(x) for x in b["doc_id"]]
                heads = np.array([[x or 0 for x in names], [x is None for x in names], b["n_bytes"]], "<i8")
                words = list(own)
                yield pd.DataFrame([(block, None, heads.tobytes(), sums.astype("<i8").tobytes())], columns=["block", "pretoken", "places", "times"])
                for lo in range(0, len(words), 20_000):
                    part = words[lo : lo + 20_000]
                    yield pd.DataFrame({"block": block, "pretoken": part, "places": [np.array(own[w][::2], "<u2").tobytes() for w in part], "times": [packed(own[w][1::2]) for w in part]})

    return docs.mapInPandas(run, FREQUENCIES)


def packed(times: list[int]) -> bytes:
    """Frequencies: nothing if all are 1, a byte each if they fit, else four with a mark in front."""
    top = max(times)
    if top == 1:
        return b""
    return np.array(times, np.uint8).tobytes() if top < 256 else b"\0" * len(times) + np.array(times, "<u4").tobytes()


def merged(block: np.ndarray, place: np.ndarray, tokens: np.ndarray) -> pd.DataFrame:
    """A row per block: places of documents, each once, and their sums."""
    order = np.lexsort((place, block))
    block, place, tokens = block[order], place[order], tokens[order]
    new_block = np.concatenate([[True], block[1:] != block[:-1]])
    first = np.flatnonzero(new_block | np.concatenate([[True], place[1:] != place[:-1]]))
    sums, place = np.add.reduceat(tokens, first), place[first].astype("<u2")
    at = np.flatnonzero(new_block[first])
    kinds = ["<u2", "<u4", "<i8"]
    rows = [(place[lo:hi].tobytes(), sums[lo:hi].astype(next(k for k in kinds if sums[lo:hi].max() <= np.iinfo(k).max)).tobytes()) for lo, hi in zip(at, [*at[1:], len(first)], strict=True)]
    return pd.DataFrame({"block": block[first][at], "heads": None, "places": [a for a, _ in rows], "sums": [b for _, b in rows]})


def frequencies_of(times: pd.Series, n: np.ndarray) -> np.ndarray:
    """The frequencies that ``packed`` wrote for rows of ``n`` documents, one after the other."""
    size, row = times.map(len).to_numpy(np.int64), np.repeat(np.arange(len(n)), n)
    out = np.ones(len(row), np.int64)
    out[(size == n)[row]] = np.frombuffer(b"".join(times[size == n]), np.uint8)
    out[(size > n)[row]] = np.frombuffer(b"".join(t[k:] for t, k in zip(times[size > n], n[size > n], strict=True)), "<u4")
    return out


def counted(rows: DataFrame, path: str) -> DataFrame:
    """(block, heads, places, sums): what pre-tokens add to documents of a block, and the blocks' own rows.

    A task holds so many postings and then sums them up per document, so it writes at most a row per row that it reads,
    whatever the number of blocks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, last, n, held, many = splitter(path), None, 0, [], 0
        for b in batches:
            own_row = b["pretoken"].isna()
            yield b[own_row].assign(heads=lambda x: x["places"], sums=lambda x: x["times"], places=None)[["block", "heads", "places", "sums"]]
            b = b[~own_row]
            if not len(b):
                continue
            tokens = b["pretoken"].to_numpy(object)
            new = np.concatenate([[tokens[0] != last], tokens[1:] != tokens[:-1]])
            counts = np.array([n, *split.count(tokens[new].tolist())], np.int64)[np.cumsum(new)]
            last, n = tokens[-1], int(counts[-1])
            size = b["places"].map(len).to_numpy(np.int64) // 2
            held.append((np.repeat(b["block"].to_numpy(np.int64), size), np.frombuffer(b"".join(b["places"]), "<u2"), np.repeat(counts, size) * frequencies_of(b["times"], size)))
            many += int(size.sum())
            if many > HELD:
                yield merged(*map(np.concatenate, zip(*held, strict=True)))
                held, many = [], 0
        if held:
            yield merged(*map(np.concatenate, zip(*held, strict=True)))

    return rows.mapInPandas(run, "block long, heads binary, places binary, sums binary")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row per row of ``docs``."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), size.alias("n_bytes"), "text")
    dealt = frequencies(rows, path).repartition("pretoken", F.when(F.col("pretoken").isNull(), F.col("block"))).sortWithinPartitions("pretoken")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heads, own = None, None, None

        def made() -> pd.DataFrame:
            doc, null, size = heads
            return pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "n_bytes": size, "n_tokens": own}).assign(doc_id=lambda x: x["doc_id"].mask(null == 1))

        for b in batches:
            out = []
            for block, raw, places, sums in zip(b["block"].tolist(), b["heads"], b["places"], b["sums"], strict=True):
                if block != key:
                    if key is not None:
                        out.append(made())
                    key, heads, own = block, np.frombuffer(raw, "<i8").reshape(3, -1), np.frombuffer(sums, "<i8").copy()
                else:
                    at = np.frombuffer(places, "<u2")
                    own[at] += np.frombuffer(sums, {2: "<u2", 4: "<u4", 8: "<i8"}[len(sums) // len(at)]).astype(np.int64)
            if out:
                yield pd.concat(out)
        if key is not None:
            yield made()

    met = counted(dealt, path).repartition("block").sortWithinPartitions("block", F.col("heads").desc_nulls_last())
    return met.mapInPandas(total, "doc_id long, n_bytes long, n_tokens long")
