"""Line de-duplication by a sharded minimal perfect hash.

Lines are counted once by their 128-bit hash (one shuffle of distinct hashes, combined map-side). Those that enough
documents hold are dealt into shards; each shard is a minimal perfect hash whose index leads to three flat arrays: a
64-bit fingerprint, the document count and the document that keeps the line. Documents then probe the arrays: no line is
joined. An index of up to BROADCAST_BYTES is sent to the texts, which don't move. A larger one stays where its shards are:
the hashes of each text's lines are dealt to the shards, those of a shard with many probes to several copies of it, and
each text meets the list of its hits once. Either way texts are read twice in all, however large the index.

Defined results: a null or empty text is one empty line. A null doc_id counts as one more document that sorts below
all others. Rows with the same doc_id are one document: their copies of a line count once and all of them keep a line
that this doc_id keeps. Lines shorter than ``min_chars`` are never dropped. A very long text is held once, with its lines,
in the task that reads it. An empty table gives an empty table. Input columns named like the added ones are replaced; all
others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import add_columns, without
from docloom.llm.perfect_hash import Lookup, build
from docloom.storage import cut

WHITE = " \t\n\x0b\x0c\r"
NO_DOC = -(2**63)
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
#: Bytes that an indexed line takes where it is probed; probes that meet one copy of a shard.
LINE_BYTES, PROBES = 22, 2_000_000


def key_digests(text: str, min_chars: int) -> tuple[list[str], list[int], list[bytes]]:
    """A text's lines, the numbers of those long enough, and the hashes of their keys."""
    lines, at, digests = text.split("\n"), [], []
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= min_chars:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
    return lines, at, digests


def as_longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs, keeper) of every line key of at least ``min_chars`` code points."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, digests = [], []
            for doc, text in zip(b["doc"].to_numpy(), b["text"], strict=True):
                own = set(key_digests(text or "", min_chars)[2])
                digests.extend(own)
                ids.append(np.full(len(own), doc, np.int64))
            h = as_longs(digests)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc": np.concatenate(ids) if ids else np.empty(0, np.int64)})

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc")
    seen = docs.select(doc, "text").mapInPandas(hashed, "h1 long, h2 long, doc long")
    if not docs.groupBy(doc).count().filter("count > 1").isEmpty():
        seen = seen.distinct()
    return seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))


#: ``load``: documents that hold its lines, so about as many probes find one.
SHARD = "shard int, n long, load long, sizes array<long>, bits array<binary>, fingerprint binary, count binary, keeper binary"


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64)
    keys = h1 ^ (h2 << np.uint64(1))
    levels = build(keys)
    at = Lookup(levels)(keys)
    order = np.argsort(at)
    take = lambda c, t: np.asarray(pdf[c].to_numpy(), t)[order].tobytes()
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "n": len(pdf), "load": int(pdf["n_docs"].sum()), "sizes": [s for s, _ in levels], "bits": [b for _, b in levels], "fingerprint": take("h2", "<i8"), "count": np.minimum(pdf["n_docs"].to_numpy(), 2**32 - 1).astype("<u4")[order].tobytes(), "keeper": take("keeper", "<i8")}])


def shard_count(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def line_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per shard: the perfect hash's levels and the arrays it leads to, over lines of ``min_docs`` documents."""
    lines = cut(line_counts(docs, min_chars).filter(F.col("n_docs") >= min_docs), "lines")
    shards = shard_count(lines.count())
    return cut(lines.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build_shard, SHARD), "line-index")


class Shards:
    """Loaded shards, probed with arrays of hashes."""

    def __init__(self, rows: list[dict], shards: int, min_docs: int):
        self.shards, self.min_docs, self.own = shards, min_docs, {}
        for r in rows:
            self.own[r["shard"]] = Lookup(list(zip(r["sizes"], r["bits"], strict=True))), np.frombuffer(r["fingerprint"], "<i8"), np.frombuffer(r["count"], "<u4"), np.frombuffer(r["keeper"], "<i8")

    def drops(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each (hash, document): is it a frequent line that another document keeps?"""
        out = np.zeros(len(h), bool)
        shard = h[:, 0] % self.shards
        for s, (lookup, fingerprint, count, keeper) in self.own.items():
            rows = np.flatnonzero(shard == s)
            u = h[rows].view(np.uint64)
            at = lookup(u[:, 0] ^ (u[:, 1] << np.uint64(1)))
            rows, at = rows[at >= 0], at[at >= 0]
            out[rows] = (fingerprint[at] == h[rows, 1]) & (count[at] >= self.min_docs) & (keeper[at] != doc[rows])
        return out


def without_lines(docs: DataFrame, start, min_chars: int) -> DataFrame:
    """``docs`` without the lines that the function which ``start`` returns, from a batch and the hashes of the lines of
    each of its texts, says to drop; plus their number."""

    def started():
        drops = start()

        def of(b: pa.RecordBatch) -> dict:
            parts = [key_digests(text, min_chars) for text in b.column("text").to_pylist()]
            drop = drops(b, [d for _, _, d in parts])
            texts, n_dropped, k = [], [], 0
            for lines, at, _ in parts:
                gone = {i for i, x in zip(at, drop[k : k + len(at)], strict=True) if x}
                k += len(at)
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines))
                n_dropped.append(len(gone))
            return {"text": texts, "n_dropped": n_dropped}

        return of

    return add_columns(docs, [("text", T.StringType()), ("n_dropped", T.LongType())], started)


def probe_broadcast(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """Texts probe all shards where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])

    def start():
        own = Shards(sent.value, shards, min_docs)

        def drops(b: pa.RecordBatch, digests: list[list[bytes]]) -> np.ndarray:
            doc = b.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy()
            return own.drops(as_longs([x for d in digests for x in d]), np.repeat(doc, [len(d) for d in digests]))

        return drops

    return without_lines(docs, start, min_chars)


def probe_dealt(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes of lines are dealt to the shards; texts meet the list of their hits by doc_id and hash."""
    named = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), "_hash": F.xxhash64("text")})
    copies = index.select("shard", F.greatest(F.ceil(F.col("load") / PROBES), F.lit(1)).cast("int").alias("copies"))
    copies = F.broadcast(copies)  # a row for SHARD_KEYS lines

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [sorted(set(key_digests(text, min_chars)[2])) for text in b["text"]]
            many = [len(x) for x in own]
            yield pd.DataFrame({"_doc": np.repeat(b["_doc"].to_numpy(), many), "_hash": np.repeat(b["_hash"].to_numpy(), many), "digest": [x for d in own for x in d], "h1": as_longs([x for d in own for x in d])[:, 0]})

    asked = named.select("_doc", "_hash", "text").mapInPandas(hashed, "_doc long, _hash long, digest binary, h1 long")
    asked = asked.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(copies, "shard")
    none = lambda *names: [F.lit(None).cast(index.schema[n].dataType).alias(n) for n in names]
    held = ["n", "sizes", "bits", "fingerprint", "count", "keeper"]
    asked = asked.select("shard", F.pmod(F.xxhash64("_doc", "_hash"), "copies").cast("int").alias("copy"), "_doc", "_hash", "digest", *none(*held))
    own = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("_doc"), F.lit(None).cast("long").alias("_hash"), F.lit(None).cast("binary").alias("digest"), *held)
    dealt = own.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("digest").isNotNull())

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, None
        for b in batches:
            shard, is_probe = b.column("shard").to_pylist(), b.column("digest").is_valid().to_pylist()
            copy = b.column("copy").to_pylist()
            at = 0
            while at < b.num_rows:
                if not is_probe[at]:
                    key, table = (shard[at], copy[at]), Shards([{n: b.column(n)[at].as_py() for n in ("shard", *held)}], shards, min_docs)
                    at += 1
                    continue
                if (shard[at], copy[at]) != key:
                    raise RuntimeError("a probe came before its shard")
                end = at + 1
                while end < b.num_rows and is_probe[end] and (shard[end], copy[end]) == key:
                    end += 1
                part = b.slice(at, end - at).select(["_doc", "_hash", "digest"])
                drop = table.drops(as_longs(part.column("digest").to_pylist()), part.column("_doc").to_numpy())
                yield part.filter(pa.array(drop))
                at = end

    hits = dealt.mapInArrow(probed, "_doc long, _hash long, digest binary").groupBy("_doc", "_hash").agg(F.collect_set("digest").alias("_drop"))

    def start():
        def drops(b: pa.RecordBatch, digests: list[list[bytes]]) -> np.ndarray:
            lists = [set(x or ()) for x in b.column("_drop").to_pylist()]
            return np.array([x in gone for d, gone in zip(digests, lists, strict=True) for x in d], bool)

        return drops

    met = named.join(cut(hits, "line-drops"), ["_doc", "_hash"], "left").drop("_doc", "_hash")
    return without_lines(met, start, min_chars).drop("_drop")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with frequent lines removed from ``text`` in all but the keeping document, plus n_lines and n_dropped."""
    index = line_index(docs, min_chars, min_docs)
    lines = index.agg(F.sum("n")).first()[0] or 0
    text = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    out = without(docs, ["n_lines", "n_dropped", "_doc", "_hash", "_drop"]).withColumns({"text": text, "n_lines": (breaks + 1).cast("long")})
    probe = probe_broadcast if lines * LINE_BYTES <= BROADCAST_BYTES else probe_dealt
    return probe(out, index, shard_count(lines), min_chars, min_docs)
