import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from docloom.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth string, parent string"


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}, by walking every conversation."""
    below, at = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in at.items():
        cost = (len(own) - 1) * len((p[-1][1] if p else "").replace("\xa0", "x").split())
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += p not in below
    ends = defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(own), len(p), min(at[p[:-1]]) if p else None, len(own), len(below[p]), leaves[p], saved[p], sha(p)) for p, own in at.items())


def shared(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - int(c / 20) * 20 if c < 0 else c % 20
    return {c: own.get(c - base(c), [])[: h(c)] + own[c][h(c) :] for c in own}


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def sample(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-25, 90), n):
        kind = rng.randint(0, 3)
        for turn in range(rng.choice([1, 1, 2, 3, 6, 17])):
            rows.append((c, turn if turn or rng.random() < 0.5 else None, "user" if turn % 2 else None, [None, "", "a b c", f"t{turn} u v"][kind] if rng.random() < 0.9 else f"own {c}"))
    rng.shuffle(rows)
    return [*rows, (None, 0, "user", "lost")]


@pytest.mark.parametrize("seed", range(3))
def test_shared_prefixes_equal_the_plain_trie(spark, seed):
    rows = sample(seed)
    assert rows_of(conversation_trie.shared_prefix_trie(table_of(spark, rows))) == plain(shared(rows))


def test_trie_of_conversations_as_they_are(spark):
    rows = [(c, t, "r", x) for c, texts in enumerate([["a b"], ["a b", "c"], ["a b", "c"], ["a b", "d", "e f"], ["", "a b"]]) for t, x in enumerate(texts)]
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    assert rows_of(conversation_trie.prefix_trie(table_of(spark, rows))) == plain(own)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "HOT", 5)  # some targets are broadcast, others are not
    rows = [(40, t, "r", f"w {t % 7}") for t in range(1000)]
    rows += [(c, t, "r", "same turn") for c in range(100, 400) for t in range(4)]
    rows += [(c, t, "r", "same turn" if t < 3 else f"own {c} {t}") for c in range(400, 460) for t in range(9)]
    assert rows_of(conversation_trie.shared_prefix_trie(table_of(spark, rows))) == plain(shared(rows))


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "r", "b"), (1, 0, "r", "a"), (2, 0, "r", "a"), (2, 0, "r", "b"), (3, 5, "r", "x"), (3, 5, "r", "x"), (3, 5, "r", "x")]
    got = rows_of(conversation_trie.prefix_trie(table_of(spark, rows)))
    assert max(r[1] for r in got if r[0] == 3) == 3, "repeated rows are turns of their own"
    assert max(r[3] for r in got if r[1] == 2) == 2, "turns with one number have one order"


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, None, "abc"), (4, 0, "abc", None), (5, 0, "1:a", "x"), (6, 0, "1", "a:x")]
    assert [r[3] for r in rows_of(conversation_trie.prefix_trie(table_of(spark, rows))) if r[1] == 1] == [1] * 6


def test_empty_table_and_turnless_conversation(spark):
    assert rows_of(conversation_trie.shared_prefix_trie(table_of(spark, []))) == []
    assert rows_of(conversation_trie.shared_prefix_trie(table_of(spark, [(None, 1, "r", "x")]))) == []
    c = next(c for c in range(20, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    assert rows_of(conversation_trie.shared_prefix_trie(table_of(spark, [(c, 0, "r", "x")]))) == plain({c: []})


def test_very_long_text(spark):
    rows = [(c, 0, "r", "word " * 1_000_000) for c in (1, 2)]
    assert [r[6] for r in rows_of(conversation_trie.prefix_trie(table_of(spark, rows)))] == [1_000_000] * 2


def test_sql(spark, tmp_path):
    rows = sample(7)
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert rows_of(queries.op12_conversation_trie(spark, str(tmp_path))) == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({queries.OP12_SQL})").fetchall())
