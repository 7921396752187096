"""Chunkers: sentences, semantic parents, fixed sizes, packed lines. Folds over one document run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"""(?<=[.?!]["')\]}»”]{0,3})\s+(?![\s\p{Ll}])|(?<=[。！？])"""
CJK = re.compile("[一-龥]")
EDGE = "".join(map(chr, range(0x21)))


def sentences(c: Column) -> Column:
    """Sentences, trimmed, none empty. A stop ends one before white space and anything but a small letter."""
    trimmed = F.transform(F.split(c, SENTENCE), lambda s: F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def estimate(text: str, cjk: float, other: float) -> int:
    n = 0 if text.isascii() else len(CJK.findall(text))
    return int(cjk * n + other * (len(text) - n))


def semantic_groups(parts: list[str], vectors: np.ndarray, threshold: float = 0.7, max_tokens: int = 800, max_sentences: int = 50, min_sentences: int = 3) -> list[str]:
    """Sentences in runs that stay near their running mean and within the limits."""
    out, group, centre, tokens = [], [], None, 0
    vectors = vectors.astype(np.float32)
    sizes = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).tolist()
    for s, v, length in zip(parts, vectors, sizes, strict=True):
        own = estimate(s, 0.5, 0.25)
        if group:
            full = len(group) >= max_sentences or tokens + own > max_tokens
            if not full and len(group) >= min_sentences:
                size = float(np.sqrt(centre @ centre)) * length
                full = (float(centre @ v) / size if size >= 1e-8 else 0.0) < threshold
            if full:
                out.append(" ".join(group))
                group, tokens = [], 0
        centre = v if not group else centre + (v - centre) / np.float32(len(group) + 1)
        group.append(s)
        tokens += own
    return [*out, " ".join(group)] if group else out


def fixed_groups(parts: list[str], max_tokens: int = 500, overlap: int = 100) -> list[str]:
    """Sentences packed to a size; the next chunk begins with the last characters of the one before."""
    out, text, tokens = [], "", 0
    for s in parts:
        own = estimate(s, 0.5, 0.25)
        if text and tokens + own > max_tokens:
            out.append(text.strip(EDGE))
            text = text[-min(overlap * 4, len(text)) :] if overlap else ""
            tokens = estimate(text, 0.5, 0.25)
        text += s + " "
        tokens += own
    return [*out, text.strip(EDGE)] if text.strip(EDGE) else out


def tail(chunk: str, overlap: int) -> str:
    """Whole lines from the end until there are enough tokens; the first line that has any may have too many."""
    kept, tokens = [], 0
    for line in filter(None, (x.strip(EDGE) for x in reversed(chunk.split("\n")))):
        own = estimate(line, 0.7, 0.3)
        if tokens >= overlap or (tokens and tokens + own > overlap):
            break
        kept.insert(0, line)
        tokens += own
    return "\n".join(kept)


def packed_lines(text: str, size: int = 200, overlap: int = 20, long_line: int = 300) -> list[str]:
    """Lines packed to a size with an overlap of lines; a very long line is a chunk of its own."""
    out, chunk, tokens = [], "", 0
    for line in filter(None, (x.strip(EDGE) for x in text.split("\n"))):
        own = estimate(line, 0.7, 0.3)
        if own > long_line:
            out += [chunk] * bool(chunk) + [line]
            chunk, tokens = "", 0
            continue
        if tokens + own > size and tokens > 0:
            out.append(chunk)
            chunk = tail(chunk, overlap)
            tokens = estimate(chunk, 0.7, 0.3)
        chunk = f"{chunk}\n{line}" if chunk else line
        tokens += own
    return [*out, chunk] if chunk else out


#: Sentences that a task embeds at once.
EMBEDDED = 5_000


def chunked(docs: DataFrame, split: Callable[[list[str], np.ndarray | None], list[tuple[str, str]]], embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(id, chunk_index, total_chunks, content, parent_content) from ``docs`` (id, parts). ``split`` gets the parts of a
    document and their embeddings, which are made for many documents at once."""

    def made(ids: list, parts: list[list[str]]) -> pa.RecordBatch:
        vectors = embedder([s for own in parts for s in own]) if embedder and any(parts) else None
        rows, at = [], 0
        for i, own in zip(ids, parts, strict=True):
            out = split(own, None if vectors is None else vectors[at : at + len(own)])
            at += len(own)
            rows += [(i, k, len(out), c, p) for k, (c, p) in enumerate(out)]
        kinds = {"id": pa.int64(), "chunk_index": pa.int32(), "total_chunks": pa.int32(), "content": pa.string(), "parent_content": pa.string()}
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Sentences become strings of Python a few documents at a time.
            many, at = np.cumsum(pc.fill_null(pc.list_value_length(b.column("parts")), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + EMBEDDED, "right")))
                own = b.slice(at, end - at)
                yield made(own.column("id").to_pylist(), own.column("parts").to_pylist())
                at = end

    return docs.filter("id is not null").select(F.col("id").cast("long").alias("id"), "parts").mapInArrow(run, "id long, chunk_index int, total_chunks int, content string, parent_content string")


def _of_sentences(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.coalesce(sentences(F.col("content")), F.array().cast("array<string>")).alias("parts"))


def semantic_chunks(docs: DataFrame, embedder) -> DataFrame:
    return chunked(_of_sentences(docs), lambda parts, v: [(c, c) for c in (semantic_groups(parts, v) if parts else [])], embedder)


def fixed_chunks(docs: DataFrame, max_tokens: int = 500, overlap: int = 100) -> DataFrame:
    return chunked(_of_sentences(docs), lambda parts, _: [(c, c) for c in fixed_groups(parts, max_tokens, overlap)])


def hierarchical_chunks(docs: DataFrame, embedder, child_tokens: int = 200) -> DataFrame:
    """Semantic parents; a parent over the child size is packed by lines."""

    def split(parts: list[str], vectors: np.ndarray | None) -> list[tuple[str, str]]:
        parents = semantic_groups(parts, vectors) if parts else []
        return [(c, p) for p in parents for c in ([p] if estimate(p, 0.7, 0.3) <= child_tokens else packed_lines(p, child_tokens))]

    return chunked(_of_sentences(docs), split, embedder)


def split_documents(docs: DataFrame, embedder=None, semantic: bool = True) -> DataFrame:
    """Chunks as a store is set up for: hierarchical ones, or sentences packed to a fixed size."""
    if semantic and embedder is None:
        raise ValueError("semantic chunks need an embedder")
    return hierarchical_chunks(docs, embedder) if semantic else fixed_chunks(docs)


def register_functions(spark) -> None:
    """SQL table functions: ``chunk_lines(text, size, overlap)`` and ``chunk_sentences(text, size, overlap)``, of which
    the second takes sentences as lines; both return (chunk_index, content)."""

    class Lines:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(packed_lines(text or "", size, overlap))

    class Sentences:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(fixed_groups([x for x in (line.strip(EDGE) for line in (text or "").split("\n")) if x], size, overlap))

    for name, of in (("chunk_lines", Lines), ("chunk_sentences", Sentences)):
        spark.udtf.register(name, F.udtf(of, returnType="chunk_index int, content string"))
