"""Golden cases of the text functions and chunkers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking, embedding


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rewrite(spark):
    cases = {"启动open-webui的两种方式是什么？": "启动open-webui的两种方式", "如何安装docker？": "安装docker", "docker怎么启动": "docker启动", "Spring AI有哪些特点？": "Spring AI", "请问如何在k8s中部署redis?": "在k8s中部署redis", "什么是Spring AI": "什么是Spring AI", "是什么意思": "是什么意思", "怎么样": "样", "如何": ""}
    assert values(spark, text.rewrite, list(cases)) == list(cases.values())
    assert values(spark, text.rewrite, [None, "  "]) == [None, "  "]


def test_estimates(spark):
    xs = ["Hello world", "启动有两种方式：", "docker安装ollama", "", None]
    assert values(spark, text.token_estimate_a, xs) == [2, 3, 4, 0, 0]
    assert values(spark, text.token_estimate_b, xs) == [3, 5, 5, 0, 0]


def test_keywords_and_variants(spark):
    q = "启动open-webui的两种方式是什么？"
    assert values(spark, text.expand_keywords, [q, "什么"]) == [["open-webui serve", "open-webui run", "open-webui start"], []]
    assert values(spark, lambda c: text.simplify(c, "启动的是什么"), [q]) == ["open-webui 两种方式"]
    assert values(spark, text.variant_cap, ["x" * n for n in (9, 10, 20, 21)]) == [3, 5, 5, 6]
    assert values(spark, lambda c: text.merge_terms(F.split(c, ",")), ["华为云,云桌面,桌面"]) == [["华为云", "云桌面"]]
    assert "mysql" in values(spark, text.core_keywords, ["contain MySQL"])[0] and "ai" in values(spark, text.core_keywords, ["contain MySQL"])[0]


def test_sentences(spark):
    cases = {"Hello world. Next one! yes? ok": 2, "line one\nline two\nline three": 1, "a b.\nc d\n\ne f": 1, "你好。世界！真的？对": 4, "A.B.C test. lower start. Upper": 2, 'he said "hi." Then left.': 2}
    assert values(spark, lambda c: F.size(chunking.sentences(c)), list(cases)) == list(cases.values())


def test_line_packing():
    line = "x" * 833
    assert chunking.estimate(line, 0.7, 0.3) == 249
    out = chunking.packed_lines(f"{line}\n{line}")
    assert out == [line, f"{line}\n{line}"]
    long = "y" * 1010
    assert chunking.packed_lines(f"a\n{long}\nb") == ["a", long, "b"]
    assert chunking.packed_lines(" \n ") == []


def test_semantic_limits():
    same = np.ones((120, 4), np.float32)
    groups = chunking.semantic_groups([f"s{i}" for i in range(120)], same)
    assert [len(g.split()) for g in groups] == [50, 50, 20]
    turn = np.array([[1, 0]] * 4 + [[0, 1]] * 4, np.float32)
    assert chunking.semantic_groups(list("abcdefgh"), turn) == ["a b c d", "e f g h"]


def test_codec(spark):
    df = spark.createDataFrame([([1.0, -0.5],)], "v array<float>").withColumn("raw", embedding.encode_vector("v"))
    row = df.select("raw", embedding.decode_vector("raw").alias("back")).first()
    assert bytes(row.raw).hex() == "3f800000bf000000" and row.back == [1.0, -0.5]


@pytest.mark.parametrize("n", [1, 3])
def test_embedder_is_deterministic(n):
    of = embedding.hashing_embedder(16, n)
    a, b = of(["same text", "same text"])
    assert (a == b).all() and abs(np.linalg.norm(a) - 1) < 1e-6
