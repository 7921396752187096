"""Packing: whole pieces, ids of the tokenizer file, gapless offsets, few sequences."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing, queries


def check(rows, docs, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    exact = Tokenizer.from_file(queries.BYTE_BPE)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = check(queries.op3_pack_sequences(spark, sf).collect(), docs)
    assert n <= least * 1.02 + 2


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "x <|endoftext|> y"), (4, "漢字 и кириллица       tab\t"), (5, "word " * 30000), (6, "a" * 20000), (7, "a"), (8, "naïve café – “quotes”  …")]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.BYTE_BPE_IDS).collect()
    check(out, docs)
    clash = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, Piece string, sequence_id int")
    check(packing.pack(clash, queries.BYTE_BPE_IDS).collect(), docs)
    same = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string"), queries.BYTE_BPE_IDS).collect()
    assert len(same) == 3 and sorted(r.offset for r in same) == [0, 3, 6]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.BYTE_BPE_IDS).count() == 0


def test_long_white_space(spark):
    long = [" " * 5_000_000, "\n" * 1_500_000, "\t" * 1_500_000]
    docs = list(enumerate([*long, *[f"Some words{x}and more. é" for x in long]]))
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.BYTE_BPE_IDS).collect(), docs)


def test_both_id_paths_agree(spark, sf):
    of = packing.Ids(**queries.BYTE_BPE_IDS)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["".join(map(chr, range(0x250))), " ".join(map(chr, range(0x250))), "a\x85b\xa0c\x1cd \x1f e", "²³ ½x ªº"]
    for t in texts:
        assert of(t).tolist() == of.exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 50, 20000])
def test_plan_lays_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.concatenate((rng.integers(1, 129, n), np.full(n // 3, 70)))
    histogram = np.bincount(lengths, minlength=129)
    plan = packing.plan(histogram)
    length = np.repeat(np.arange(129), histogram)
    number = np.concatenate([np.arange(k) for k in histogram]) if n else np.empty(0, np.int64)
    if n:
        seq, off = plan.at(length, number)
        order = np.lexsort((off, seq))
        s, o, w = seq[order], off[order], length[order]
        first = np.concatenate(([True], s[1:] != s[:-1]))
        assert (o[first] == 0).all() and (o[1:] == o[:-1] + w[:-1])[~first[1:]].all() and (o + w).max() <= 128
        least = max(length.sum() / 128, (length > 64).sum())  # no two longer ones share a sequence
        assert len(set(seq)) == plan.n_sequences <= 1.01 * least + 2
