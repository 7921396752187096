"""Embeddings: a deterministic hashing embedder, the vector codec, centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.storage import slices


#: Bytes of texts that are hashed at once.
HASHED = 1 << 18


def hashing_embedder(dim: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """Character n-grams hashed to signed dimensions, length 1; stands in for a model."""

    def counted(raw: list[bytes]) -> np.ndarray:
        """Signed counts; all texts are read as one row of bytes, n-grams that cross from one to the next left out."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        if len(data) < n:
            return np.zeros((len(raw), dim), np.float32)
        code = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + data[k : len(data) - n + 1 + k]
        code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        row, left = np.repeat(np.arange(len(raw)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
        whole = left[: len(code)] >= n
        code, row = code[whole] >> np.uint64(32), row[: len(whole)][whole]
        at = row * dim + (code % np.uint64(dim)).astype(np.int64)
        sign = np.where(code >> np.uint64(31) > 0, 1.0, -1.0)
        return np.bincount(at, sign, len(raw) * dim).reshape(-1, dim).astype(np.float32)

    def embed(texts: list[str]) -> np.ndarray:
        raw, out, at = [f" {t.lower()} ".encode() for t in texts], [np.zeros((0, dim), np.float32)], 0
        while at < len(raw):
            end, held = at, 0
            while end < len(raw) and (end == at or held + len(raw[end]) <= HASHED):
                held += len(raw[end])
                end += 1
            with np.errstate(over="ignore"):
                out.append(counted(raw[at:end]))
            at = end
        counts = np.concatenate(out)
        size = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(size > 0, size, 1)

    return embed


def embedded(batches: Iterator[pa.RecordBatch], text: str, embedder: Callable[[list[str]], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches with ``embedding``. Texts become strings of Python a few at a time, and leave as they came."""
    for b in batches:
        for own in slices(b, text):
            vectors = np.asarray(embedder(own.column(text).to_pylist()), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, "embedding"])


def embed_texts(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``df`` without blank texts, with ``embedding``; each distinct text is embedded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return embedded(batches, text, embedder)

    # Texts meet by two 64-bit hashes; those that agree in both are compared when they are joined.
    keys = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)}
    kept = df.filter(F.regexp_replace(text, r"[\x00-\x20]", "") != "").withColumns(keys)
    made = kept.groupBy("_h1", "_h2").agg(F.min(text).alias(text)).mapInArrow(run, f"_h1 long, _h2 long, `{text}` string, embedding array<float>")
    return kept.join(made.withColumnRenamed(text, "_text"), ["_h1", "_h2"]).filter(F.col(text) == F.col("_text")).drop("_h1", "_h2", "_text")


def encode_vector(c: Column | str) -> Column:
    """Big-endian float32, one after the other."""
    return F.pandas_udf(lambda v: v.map(lambda x: None if x is None else np.asarray(x, ">f4").tobytes()), T.BinaryType())(c)


def decode_vector(c: Column | str) -> Column:
    return F.pandas_udf(lambda v: v.map(lambda x: None if x is None else np.frombuffer(x, ">f4").astype(np.float32)), T.ArrayType(T.FloatType()))(c)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, pos, value): the mean of each component."""
    each = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy(key, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))
