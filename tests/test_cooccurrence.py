"""The learned embedder: its steps against plain matrices, and neighbours by topic."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import cooccurrence, embedding

TEXTS = ["the cat sat on the mat the cat ran", "a dog ran on the mat", None, "", "The DOG sat!", "cat dog cat dog"]


def plain_counts(texts, window, least=1):
    own = [cooccurrence.PLAIN.findall((t or "").lower()) for t in texts]
    n = defaultdict(int)
    for t in own:
        for w in t:
            n[w] += 1
    order = sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], w))
    at = {w: i for i, w in enumerate(order)}
    m = np.zeros((len(at), len(at)))
    for t in own:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + window + 1)):
                if t[i] in at and t[j] in at:
                    m[at[t[i]], at[t[j]]] += 1 / (j - i)
                    m[at[t[j]], at[t[i]]] += 1 / (j - i)
    return order, m


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.mark.parametrize("least", [1, 2])
def test_matrix_equals_plain(spark, least):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    order, counts = plain_counts(TEXTS, 3, least)
    words = cooccurrence.words_of(docs, "text")
    known = {r.word: r.i for r in cooccurrence.vocabulary(words, least, 100).collect()}
    assert sorted(known, key=known.get) == order
    got = cooccurrence.pairs(words, known, 3)
    assert np.allclose(dense(got, len(order)), counts)
    s = counts.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ppmi = np.maximum(0, np.log(counts * counts.sum() / np.outer(s, s)))
    assert np.allclose(dense(cooccurrence.information(got), len(order)), np.where(counts > 0, ppmi, 0))


def test_factors_equal_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    m = (basis * np.r_[30, -20, 12, 8, 5, np.zeros(55)]) @ basis.T
    rows = [(i, j, float(m[i, j])) for i in range(60) for j in range(60)]
    out = cooccurrence.factorised(spark.createDataFrame(rows, "i long, j long, v double").repartition(4), 3).orderBy("i").collect()
    x = np.array([r.x for r in out])
    best = (basis[:, :3] * np.abs([30, -20, 12])) @ basis[:, :3].T
    assert x.shape == (60, 3) and np.allclose(x @ x.T, best, atol=1e-6)


def test_neighbours_by_topic_are_better_than_hashing(spark):
    """Texts of eight topics, each with sixty words of its own; a text holds six of them, among words that all topics share."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    topics, common = [[word() for _ in range(60)] for _ in range(8)], [word() for _ in range(30)]
    rows = [(i, i % 8, " ".join(rng.sample(rng.choices(topics[i % 8], k=6) + rng.choices(common, k=6), 12))) for i in range(3000)]
    learned = cooccurrence.fit(spark.createDataFrame(rows, "id int, topic int, text string").repartition(4), dim=16, window=12)
    topic = np.array([t for _, t, _ in rows])

    def right(of):
        x = of([t for _, _, t in rows])
        score = x[:300] @ x.T
        score[np.arange(300), np.arange(300)] = -2
        return (topic[np.argsort(-score, axis=1)[:, :5]] == topic[:300, None]).mean()

    own = cooccurrence.embedder(learned, 16)
    assert right(own) >= 0.95 > right(embedding.hashing_embedder(64)) + 0.2
    made = embedding.embed_texts(spark.createDataFrame(rows[:20], "id int, topic int, text string"), "text", own)
    assert np.allclose([r.embedding for r in made.orderBy("id").collect()], own([t for _, _, t in rows[:20]]), atol=1e-6)


def test_empty_table(spark):
    none = spark.createDataFrame([(None,), ("once only",)], "text string")
    learned = cooccurrence.fit(none, dim=4)
    assert learned.count() == 0 and not cooccurrence.embedder(learned, 4)(["once", ""]).any()


def test_sums_of_vectors(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("i"), F.lit(2.0).alias("v"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("x")).repartition(5)
    got = {r.i: r.x for r in cooccurrence.summed(rows, 2).collect()}
    assert got == {k: [2.0 * len(range(k, 1000, 7)), 2.0 * sum(range(k, 1000, 7))] for k in range(7)}


def test_products_in_tiles(spark, monkeypatch):
    """A row per tile moves, not one per entry with a vector."""
    monkeypatch.setattr(cooccurrence, "BLOCK", 16)
    rng = np.random.default_rng(6)
    m, y = np.where(rng.random((40, 40)) < 0.3, rng.random((40, 40)), 0), rng.normal(size=(48, 3))
    tiles = cooccurrence.tiled(spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double"))
    assert tiles.count() == 9
    blocks = spark.createDataFrame([(b, y[16 * b : 16 * b + 16].ravel().tolist()) for b in range(3)], "i long, x array<double>")
    got = {r.i: np.array(r.x).reshape(16, 3) for r in cooccurrence.multiplied(tiles, blocks, 3).collect()}
    assert np.allclose(np.concatenate([got[b] for b in range(3)])[:40], m @ y[:40])
