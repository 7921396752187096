"""The keyword index against the scan."""

import random

import numpy as np
import pytest

from docloom.operators import postings, search
from docloom.plans import queries as core

SCHEMA = "id long, content string"


def test_grams():
    number = lambda s: (ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])
    assert set(postings.grams_of(["abcd", "", "xy", "bcde", "😀é\n"])) == {number(x) for x in ("abc", "bcd", "cde", "😀é\n")}
    assert not len(postings.grams_of(["ab", "c", ""]))


def test_postings_come_back():
    rng = np.random.default_rng(3)
    pairs = {(int(g), int(b)) for g, b in zip(rng.integers(0, 40, 500), rng.choice([3, 200, 70_000, 2**33], 500) * rng.integers(1, 9, 500), strict=True)}
    made = postings.coded(*(np.array(x) for x in zip(*pairs, strict=True)))
    back = {(r.gram, int(b)) for r in made.itertuples() for b in postings.decoded(r.first, r.n, r.steps)}
    assert back == pairs and made["gram"].is_unique


def test_literals():
    of = postings.literals
    assert of("abc") == ["abc"] and of("a%b_cd%") == ["a", "b", "cd"] and of("a\\%b\\_c\\\\d") == ["a%b_c\\d"] and of("%_") == [] and of("") == []


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """2000 texts in 60 blocks: syllables, and rare words in some."""
    rng = random.Random(6)
    syllables = ["the", "ti", "on", "ä", "日本", "x_y", "50%", "İ", "b\\c"]
    texts = [(i * 3, None if i % 97 == 0 else "".join(rng.choice(syllables) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(2000)]
    texts += [(601, "Zebra crossing"), (602, "zebra only"), (603, "crossing"), (601, "Zebra crossing"), (None, "zebra"), (4000, "zeb"), (4001, "ra zeb")]
    chunks = spark.createDataFrame(texts, SCHEMA)
    whole = postings.BLOCK_ROWS
    postings.BLOCK_ROWS = 32
    yield chunks, postings.KeywordIndex.build(chunks, f"{tmp_path_factory.mktemp('kw')}/index")
    postings.BLOCK_ROWS = whole


KEYWORDS = [["zebra"], ["ZEBRA"], ["zebra", "日本the"], ["zeb%cross"], ["z_bra"], ["zebra%zebra"], ["the"], ["on"], ["x\\_y"], ["x_y"], ["50\\%"], ["b\\\\c"], ["absent"], ["absent", "ti"], ["%"], ["_"], ["ä日本"], ["cross%zebra"], ["ononon", "tititi"]]


@pytest.mark.parametrize(("named", "limit"), [(0, 5), (3, 10_000), (200, 5)])
def test_hits_equal_the_scan(spark, made, monkeypatch, named, limit):
    monkeypatch.setattr(postings, "NAMED", named)
    chunks, index = made
    for keywords in KEYWORDS if named == 3 else KEYWORDS[:3]:
        want = [r.id for r in search.keyword_hits(chunks.filter("id is not null"), keywords, limit).collect()]
        assert [r.id for r in index.hits(spark, keywords, limit).collect()] == want, keywords
    assert index.hits(spark, [], limit).count() == 0


def test_few_blocks_are_read(spark, made):
    _, index = made
    n = lambda *k: index.candidates(spark, list(k)).count()
    assert index.blocks > 60 and n("zebra crossing") == 1 and n("absent") == 0 and n("zebra") <= 2
    assert index.candidates(spark, ["zebra", "ab"]) is None
    assert index.narrowed(spark, ["zebra crossing"]).count() <= 32
    parts = index.narrowed(spark, ["zebra crossing"]).select("part").distinct().count()
    assert parts == 1, "one folder of many is read"


def test_empty_index(spark, tmp_path):
    index = postings.KeywordIndex.build(spark.createDataFrame([(1, None), (None, "text")], SCHEMA), f"{tmp_path}/e")
    assert index.hits(spark, ["text"], 5).count() == 0 and index.hits(spark, ["t"], 5).count() == 0


def test_rare_words_of_documents(spark, tmp_path):
    """What a search reads, in bytes of texts, on the documents of sf0.1."""
    chunks = core.chunks(spark, "/root/testdata/sf0.1")
    index = postings.KeywordIndex.build(chunks, f"{tmp_path}/d")
    size = lambda df: df.selectExpr("coalesce(sum(octet_length(content)), 0) as n").first()["n"]
    for keywords, most in ((["2024"], 0.1), (["qqqqq"], 0.0)):
        assert size(index.narrowed(spark, keywords)) <= most * size(chunks)
        assert [r.id for r in index.hits(spark, keywords, 40).collect()] == [r.id for r in search.keyword_hits(chunks, keywords, 40).collect()]


def test_growing_index(spark, tmp_path, made):
    """Batches, one of them again with other rows, merged and grown on: what a scan of the rows finds."""
    chunks, _ = made
    own, limit = postings.GrowingIndex(f"file://{tmp_path}/growing"), 10_000
    assert own.hits(spark, ["zebra"], limit).count() == 0
    found = lambda ks, deleted=None: [r.id for r in own.hits(spark, ks, limit, deleted).collect()]
    wanted = lambda rows, ks: [r.id for r in search.keyword_hits(rows.filter("id is not null"), ks, limit).collect()]
    parts = [chunks.filter("id < 600"), chunks.filter("id between 600 and 3000"), chunks.filter("id > 3000")]
    own.add(parts[0], 0)
    own.add(parts[2], 1)
    own.add(parts[1], 1)  # the batch again: it replaces itself
    for ks in (["zeb%cross", "absent"],):
        assert found(ks) == wanted(chunks.filter("id <= 3000"), ks)
    own.merge(spark)
    own.add(parts[2], 2)
    own.add(chunks.limit(0), 3)
    assert [s[:2] for s in own.segments(spark)] == [(0, 1), (2, 2), (3, 3)]
    gone = spark.createDataFrame([(602,), (4000,)], "id long")
    for ks in (["zeb"], ["the"]):
        assert found(ks) == wanted(chunks, ks)
        assert found(ks, gone) == [i for i in wanted(chunks, ks) if i not in (602, 4000)]
    assert found([]) == []


def test_postings_are_packed_without_rows_of_python():
    grams = np.array([5, 5, 5, 7, 9, 9, 11, 11, 12, 12])
    blocks = np.array([300, 1, 2, 4, 0, 70_000, 1, 2**33, 8, 9])
    made = postings.packed(grams, blocks)
    assert [len(x) for x in made.column("steps").to_pylist()] == [4, 0, 4, 8, 1]
    rows = zip(*(made.column(c).to_pylist() for c in ("gram", "first", "n", "steps")), strict=True)
    assert sorted((g, int(b)) for g, f, n, s in rows for b in postings.decoded(f, n, s)) == sorted(zip(grams.tolist(), blocks.tolist(), strict=True))
