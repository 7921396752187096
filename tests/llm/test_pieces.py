"""SentencePiece against the library, and the way back."""

import hashlib
import random
import struct
import zlib

import numpy as np

from docloom.llm import queries, sentence_pieces

PATH = queries.public_tokenizers.path("piece_bpe_32k.model")


def test_query(spark, sf):
    """Ids in order and decoded texts of every document."""
    sp = sentence_pieces.model(PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = sp.encode(r.text)
        want[r.doc_id] = (len(ids), sum(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), True)
    got = {r.doc_id: (r.n_pieces, r.id_sum, r.ids_crc32, r.text_sha256, r.round_trip) for r in queries.op10_sentence_pieces(spark, sf).collect()}
    assert got == want


def test_edges(spark):
    sp = sentence_pieces.model(PATH)
    texts = [None, "", " ", "  two  spaces ", "漢字 кириллица 🙂", "tab\tand\nline", "a" * 300, "x" + "▁y", "don't stop", "www.example.com/a?b=1"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(1, "again", "z"), (None, "null id", "z")], "doc_id long, text string, ids string")
    out = sentence_pieces.encode(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), sp.encode(r.text or "")) for r in docs.collect())
    back = {r.row: r.text for r in sentence_pieces.decode(spark.createDataFrame(out), PATH).collect()}
    for r in out:
        assert back[r.row] == sp.decode(r.ids)
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0
    assert sentence_pieces.encode_and_decode(docs.limit(0), PATH).count() == 0


def test_viterbi_fold(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select 3 as n, 3 as w, array(-1.0D, -1.5D, null, -9.0D, -0.1D, null, -1.0D, null, null) as v")
    assert df.select(sentence_pieces.viterbi(F.col("n"), F.col("w"), F.col("v"))).first()[0] == [1, 2, 4]


def test_merges_against_library(spark):
    """Units of every length up to the limit and beyond, alone and behind other units."""
    rng = random.Random(5)
    sp = sentence_pieces.model(PATH)
    texts = ["".join(rng.choice("etaonrisühé.,-=$'1² ") for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["x" + "=" * 100, "=" * 39 + "x" * 41, "²." * 30, "the " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in sentence_pieces.encode(docs, PATH).collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_long_units(spark, monkeypatch):
    """Units that can be cut, units that can't, and periods that merge in rounds; no part of it through the library."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("etaonrisch") for _ in range(n))
    sp = sentence_pieces.model(PATH)
    texts = [f(n) for n in (17, 41, 400) for f in (letters, lambda n: "=" * n, lambda n: "a" * n, lambda n: "ab" * n, lambda n: "漢字" * n, lambda n: " " * n + "x", lambda n: "the" * n)]
    texts += ["=" * 40_000, letters(3000), "x" + "-=" * 2500]
    want = {i: sp.encode(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.ids for r in sentence_pieces.encode(docs, PATH).collect()} == want


def test_windows():
    assert sentence_pieces.windows(10, np.array([0, 3, 4]), np.array([2, 2, 2]), 4) == [0, 3, 7, 10]
    assert sentence_pieces.windows(6, np.array([0, 1, 2, 3, 4]), np.array([2] * 5), 4) == [0, 6]
    assert sentence_pieces.windows(3, np.array([0]), np.array([1]), 2) == [0, 2, 3]


def test_unigram_path(spark):
    """The operator with the other fold: each unit's path has the highest total score."""
    sp = sentence_pieces.model(PATH)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in sentence_pieces.plain_ids(sp)}
    words = ["▁the", "▁hausen", "▁electricity", "...", "▁été"]

    def best(u):
        top = [0.0] + [None] * len(u)
        for end in range(1, len(u) + 1):
            top[end] = max(top[lo] + score.get(u[lo:end], -1e6 if end - lo == 1 else -1e12) for lo in range(end))
        return top[-1]

    got = {r.unit: r.ids for r in sentence_pieces.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), PATH, unigram=True).collect()}
    for w in words:
        assert sum(sp.get_score(i) for i in got[w]) == best(w)
