import random
import re

import duckdb
import numpy as np
import pytest

from docloom.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_words string, ITEMS string", "item_id long, text string, extra int"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(texts, items, window=10):
    """(words, hit words, items) of each text, by trying every pattern at every place."""
    patterns = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            patterns.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for text in texts:
        w, hit, named = words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in patterns:
                    hit |= set(range(k, k + m))
                    named |= patterns[p]
        out.append((len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return out


def found(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), **options)
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    for r in rows:
        ends = [x for s in r["spans"] for x in (s["begin"], s["end"])]
        assert ends == sorted(set(ends)) or not ends, "spans are in order and don't touch"
    return [(r["n_words"], sum(s["end"] - s["begin"] for s in r["spans"]), r["items"]) for r in rows]


def sample(seed, n=12):
    rng = random.Random(seed)
    known = [w * rng.randint(1, 3) for w in ("a", "B", "É", "x1", "日本")][: rng.choice([1, 3, 5])]
    text = lambda k: "".join(rng.choice(known) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(k))
    items = [(rng.choice([None, 1, 2, 10, 11]), text(rng.choice([0, 1, 2, 9, 10, 11, 40]))) for _ in range(n)]
    texts = [text(rng.choice([0, 3, 60, 400])) + rng.choice(items)[1] + text(4) for _ in range(n)]
    return [*texts, None, "", " \n-", texts[0]], [*items, items[0], (5, None), (6, "")]


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_trying_every_pattern(seed, monkeypatch):
    texts, items = sample(seed)
    monkeypatch.setattr(decontaminate, "LANE", [1, 7, 512][seed % 3])
    monkeypatch.setattr(decontaminate, "SLICE", [5, 1 << 20][seed % 2])
    searcher = decontaminate.Searcher([(None if i is None else str(i), " ".join(words(t)).encode()) for i, t in items if words(t)], 10)
    with np.errstate(over="ignore"):
        n, spans, names = searcher([None if t is None else t.encode() for t in texts])
    assert [(a, sum(s["end"] - s["begin"] for s in b), c) for a, b, c in zip(n, spans, names, strict=True)] == plain(texts, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_one_block_and_many_give_the_same(spark, block_bytes):
    texts, items = sample(3)
    assert found(spark, texts, items, block_bytes=block_bytes, piece=4) == plain(texts, items)


def test_long_items_and_texts(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(60_000))
    inside = " ".join(long.split()[40_000:40_015])
    texts, items = [long, f"one {inside} two", "x" * 3_000_000, "a " * 1_500_000], [(1, long), (2, "a " * 12)]
    got = found(spark, texts, items)
    assert got == [(60_000, 60_000, ["1"]), (17, 15, ["1"]), (1, 0, []), (1_500_000, 1_500_000, ["2"])]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, ["a b", None], []) == [(2, 0, []), (0, 0, [])]
    assert found(spark, ["a b"], [(1, None), (2, "--")]) == [(2, 0, [])]


def test_items_with_many_windows_in_common(spark):
    items = [(i, "of the " * 30 + f"w{i}") for i in range(300)]
    assert found(spark, ["the of " * 20, "w7"], items) == [(40, 40, sorted(map(str, range(300)))), (1, 0, [])]


def test_sql_on_small_cases(spark, tmp_path):
    texts, items = sample(8)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op11_decontaminate(spark, str(tmp_path)).orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == con.execute(f"select {', '.join(got.columns)} from ({queries.OP11_SQL}) order by doc_id").fetchall()
