"""The learned lexicon against plain counting, and its cuts against pairs of characters."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docloom.functions import text
from docloom.operators import lexicon

HAN = re.compile("[一-龥]+")


def plain(texts, longest=4, least=5, cohesion=2.0, freedom=1.0):
    n, beside = Counter(), defaultdict(Counter)
    edge = itertools.count()
    for run in (r for t in texts for r in HAN.findall(t or "")):
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + longest) + 1):
                w = run[i:j]
                n[w] += 1
                beside[w, 0][run[i - 1] if i else next(edge)] += 1
                beside[w, 1][run[j] if j < len(run) else next(edge)] += 1
    total = sum(k for w, k in n.items() if len(w) == 1)
    entropy = lambda c: -sum(k / c.total() * math.log(k / c.total()) for k in c.values())
    out = {}
    for w, k in n.items():
        if len(w) > 1 and k >= least:
            tight = min(math.log(k * total / (n[w[:i]] * n[w[i:]])) for i in range(1, len(w)))
            free = min(entropy(beside[w, 0]), entropy(beside[w, 1]))
            if tight >= cohesion and free >= freedom:
                out[w] = (k, round(k / total, 9), round(tight, 9), round(free, 9))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    """Sentences of invented words of one to four characters, their words, and what is learned from them."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + i * 37) for i in range(300)]
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))) for _ in range(150)]
    weights = [1 / (i + 5) for i in range(150)]
    sentences = [rng.choices(vocabulary, weights, k=rng.randint(3, 12)) for _ in range(1500)]
    texts = ["".join(s) + rng.choice(["。", "，ok ", "\n"]) for s in sentences]
    rows = [(t, "x") for t in [*texts, None, "", "no han", "字", texts[0]]]
    learned = lexicon.learn(spark.createDataFrame(rows, "text string, word string").repartition(5))
    return sentences, [t for t, _ in rows], learned


def test_lexicon_equals_plain_counting(sample, monkeypatch):
    _, texts, learned = sample
    got = {r.word: (r.n, round(r.share, 9), round(r.cohesion, 9), round(r.freedom, 9)) for r in learned.collect()}
    assert got == plain(texts) and len(got) > 80


def marks(words):
    return set(itertools.accumulate(map(len, words[:-1])))


def test_cuts_are_better_than_pairs(spark, sample):
    """Share of word borders that are right, of those found and of those there."""
    sentences, _, learned = sample
    own = lexicon.Lexicon.of(learned)

    def f1(cut):
        right = found = there = 0
        for s in sentences[:300]:
            a, b = marks(cut("".join(s))), marks(s)
            right, found, there = right + len(a & b), found + len(a), there + len(b)
        return 2 * right / (found + there)

    pairs = lambda s: re.findall("..?", s)
    assert f1(own.cut) >= 0.9 > 0.7 > f1(pairs)
    texts = spark.createDataFrame([("".join(s),) for s in sentences[:50]], "t string")
    assert [r.w for r in texts.select(own.segments(texts["t"]).alias("w")).collect()] == [own.cut("".join(s)) for s in sentences[:50]]


def test_best_cut_equals_trying_all():
    rng = random.Random(8)
    words = {"".join(rng.choice("一二三") for _ in range(rng.randint(2, 4))): math.log(rng.random()) for _ in range(12)}
    own = lexicon.Lexicon(words, math.log(0.01), 4)
    for _ in range(40):
        run = "".join(rng.choice("一二三四") for _ in range(rng.randint(1, 9)))
        ways = []
        for borders in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0, *[i + 1 for i, b in enumerate(borders) if b], len(run)]
            way = [run[i:j] for i, j in itertools.pairwise(at)]
            if all(len(w) == 1 or w in words for w in way):
                ways.append((round(sum(words.get(w, own.alone) if len(w) > 1 else own.alone for w in way), 9), [len(w) for w in way]))
        assert [len(w) for w in own.cut(run)] == max(ways)[1]


def test_keywords_and_edges(spark, sample):
    docs = spark.createDataFrame([(t,) for t in ["如何部署云桌面和Docker", None, "", "abc-1 的"] + ["云桌面教程", "部署云桌面吧", "看云桌面", "部署完成", "先部署后教程"] * 5], "text string")
    own = lexicon.Lexicon.of(lexicon.learn(docs, least=5, cohesion=0.5, freedom=0.0))
    got = [r.k for r in docs.limit(4).select(own.core_keywords(docs["text"]).alias("k")).collect()]
    assert got[0] and "云桌面" in got[0] and "部署" in got[0] and "docker" in got[0] and got[1] is None and got[2:] == [[], ["abc-1"]]
    none = lexicon.learn(docs.filter("text = 'abc'"))
    assert none.count() == 0 and lexicon.Lexicon.of(none).cut("云桌面") == ["云", "桌", "面"]
    known = lexicon.Lexicon.of(none, {w: 1e-4 for w in text.CUSTOM_TERMS if HAN.fullmatch(w)})
    assert known.cut("在云桌面上") == ["在", "云桌面", "上"]
