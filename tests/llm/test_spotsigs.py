"""Spot signatures: hand-made sets, edges, and the search by prefix against all pairs."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from docloom.llm import spotsigs


def test_signatures(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat; and a Dog ran home"), (2, ""), (3, "one two"), (4, "?!")], "id int, text string")
    got = {r.id: sorted(r.s) for r in spotsigs.with_signatures(df, "text", "s").collect()}
    assert got == {1: ["cat sat", "dog ran", "mat dog"], 2: [], 3: ["=one two"], 4: ["=?!"]}


def test_edges(spark):
    texts = {5: "the cat " * 40000, 4: "", 3: None, 2: "abcdef", 1: "xy", None: "zz top", 0: "the end of the line"}
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id long, text string, fingerprint string")
    out = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    assert len(out) == len(texts)
    order = [5, 4, 3, 2, 1, 0, None]
    for i, d in enumerate(order):
        text, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(text) // 3
        want = text[: len(text) - third] + following[:third]
        assert out[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and out[d].n_chars == len(text)
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
        assert (out[d].fingerprint == out[d].edited_fingerprint) == (out[d].near_edited == 1)
    assert out[4].near_next == 1 and out[4].fingerprint == out[3].fingerprint
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0
    assert spotsigs.fingerprints(docs.limit(1)).count() == 1
    assert spotsigs.fingerprints(docs.union(docs)).count() == 2 * len(texts)


def test_similar_finds_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(r.s) for r in spotsigs.with_signatures(docs, "text", "s").collect()}
    near = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    random.seed(1)
    asked = random.sample(sorted(sets), 40)
    want = {(q, d) for q in asked for d in sets if near(sets[q], sets[d]) >= 0.5}
    got = {(r.query_id, r.doc_id) for r in spotsigs.similar(docs.filter(F.col("doc_id").isin(asked)), docs, 0.5).collect()}
    assert got == want and len(want) > len(asked)


def test_empty_sets_are_alike(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "the cat is a dog")], "doc_id long, text string")
    assert {(r.query_id, r.doc_id, r.likeness) for r in spotsigs.similar(docs, docs, 0.5).collect()} == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)}


def test_likeness_is_pruned_without_a_change(spark):
    """Sets of 1 to 60 elements: what length partitions rule out is what falls below the least likeness."""
    sets = [list(range(lo, lo + n)) for n in (1, 2, 3, 5, 8, 20, 60) for lo in (0, 1)] + [[]]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<int>, b array<int>")
    for least in (0.1, 0.5, 0.75):
        for r in df.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), least).alias("j")).collect():
            a, b = set(r.a), set(r.b)
            j = len(a & b) / len(a | b) if a and b else float(a == b)
            assert r.j == (j if j >= least else 0.0)


LONG = """
import random
from pyspark.sql import SparkSession
from docloom.llm import spotsigs
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1800m").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
rng = random.Random(1)
words = ["the", "and", "of"] * 3000 + [f"w{i}" for i in range(20000)]
text = " ".join(rng.choice(words) for _ in range(2_200_000))
docs = spark.createDataFrame([(i, "the cat sat on a mat") for i in range(7)] + [(99, text)], "doc_id long, text string")
print("chars", len(text), "rows", len(spotsigs.fingerprints(docs).collect()))
"""


def test_long_text_in_little_memory():
    """A text of 12 MB in a JVM with 1.8 GB of heap."""
    out = subprocess.run([sys.executable, "-c", LONG], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    words = out.stdout.split()
    assert words[-1] == "8" and int(words[1]) > 12_000_000, out.stderr[-2000:]
