"""Chunkers and the embedder against plain versions over a whole small table; the index against the exact search."""

import math
import re

import numpy as np
import pytest

from docloom.operators import chunking, embedding
from docloom.plans import queries as core

WHITE = "".join(map(chr, range(33)))


def plain_sentences(text):
    """Character by character: a stop with up to three closing marks, white space, then anything but a small letter."""
    out, begin, i = [], 0, 0
    while i < len(text):
        if text[i] in "。！？":
            out.append(text[begin : i + 1])
            begin = i + 1
        elif text[i] in ".?!":
            end = i + 1
            while end < len(text) and end - i <= 3 and text[end] in "\"')]}»”":
                end += 1
            gap = end
            while gap < len(text) and text[gap] in " \t\n\x0b\f\r":
                gap += 1
            if gap > end and not (gap < len(text) and text[gap].islower()):
                out.append(text[begin:end])
                begin = gap
                i = gap - 1
        i += 1
    out.append(text[begin:])
    return [s.strip(WHITE) for s in out if s.strip(WHITE)]


def tokens(text, cjk, other):
    n = sum("一" <= c <= "龥" for c in text)
    return math.floor(cjk * n + other * (len(text) - n))


def plain_vector(text, dim=64, n=3):
    raw, out = f" {text.lower()} ".encode(), [0] * dim
    for at in range(len(raw) - n + 1):
        code = 0
        for byte in raw[at : at + n]:
            code = code * 257 + byte
        code = (code + 1) * 0x9E3779B97F4A7C15 % 2**64
        code = (code ^ code >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        out[(code >> 32) % dim] += 1 if code >> 63 else -1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size if size else 0.0 for x in out]


def plain_parents(parts):
    groups, group = [], []
    for s in parts:
        v = np.array(plain_vector(s))
        if group:
            mean = np.mean([x for _, x in group], axis=0)
            size = np.linalg.norm(mean) * np.linalg.norm(v)
            near = mean @ v / size if size >= 1e-8 else 0.0
            much = sum(tokens(x, 0.5, 0.25) for x, _ in group) + tokens(s, 0.5, 0.25) > 800
            if len(group) >= 50 or much or (len(group) >= 3 and near < 0.7):
                groups.append(group)
                group = []
        group.append((s, v))
    return [" ".join(x for x, _ in g) for g in [*groups, group] if g]


def plain_children(text):
    own = lambda x: tokens(x, 0.7, 0.3)
    lines, done, held, n = [x.strip(WHITE) for x in text.split("\n") if x.strip(WHITE)], [], [], 0
    for line in lines:
        if own(line) > 300:
            done += ["\n".join(held)] * bool(held) + [line]
            held, n = [], 0
            continue
        if n and n + own(line) > 200:
            done.append("\n".join(held))
            kept, have = [], 0
            for back in reversed(held):
                if have >= 20 or (have and have + own(back) > 20):
                    break
                kept, have = [back, *kept], have + own(back)
            held, n = kept, own("\n".join(kept))
        held, n = [*held, line], n + own(line)
    return done + ["\n".join(held)] * bool(held)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.id: r.content for r in core.chunks(spark, sf).select("id", "content").collect()}


def by_document(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.id, r.chunk_index)):
        out.setdefault(r.id, []).append(r)
    for own in out.values():
        assert [r.chunk_index for r in own] == list(range(own[0].total_chunks))
    return out


def test_sentences_against_plain(spark, sf, documents):
    got = {}
    for r in core.sentence_split(spark, sf).orderBy("id", "i").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert got == {i: s for i, t in documents.items() if (s := plain_sentences(t or ""))}


def test_semantic_against_plain(spark, sf, documents):
    got = {i: [r.content for r in own] for i, own in by_document(core.chunk_semantic(spark, sf).collect()).items()}
    assert got == {i: p for i, t in documents.items() if (p := plain_parents(plain_sentences(t or "")))}


def test_hierarchical_against_plain(spark, sf, documents):
    got = {i: [(r.content, r.parent_content) for r in own] for i, own in by_document(core.chunk_hierarchical(spark, sf).collect()).items()}
    want = {}
    for i, t in documents.items():
        rows = [(c, p) for p in plain_parents(plain_sentences(t or "")) for c in ([p] if tokens(p, 0.7, 0.3) <= 200 else plain_children(p))]
        if rows:
            want[i] = rows
    assert got == want


def test_fixed_against_plain(spark, sf, documents):
    got = {i: [r.content for r in own] for i, own in by_document(core.chunk_fixed(spark, sf).collect()).items()}
    want = {}
    for i, t in documents.items():
        out, text, n = [], "", 0
        for s in plain_sentences(t or ""):
            if text and n + tokens(s, 0.5, 0.25) > 500:
                out.append(text)
                text = text[-400:]
                n = tokens(text, 0.5, 0.25)
            text, n = f"{text}{s} ", n + tokens(s, 0.5, 0.25)
        out = [x.strip(WHITE) for x in [*out, text] if x.strip(WHITE)]
        if out:
            want[i] = out
    assert got == want


def test_children_of_lines():
    """Lines without tokens, lines that are too long, overlaps."""
    cases = ["x" * 100 + "\n}\n" + "y" * 700, "\n".join("ab cd ef " * (1 + i % 7) + str(i) for i in range(200)), "z" * 1200 + "\nq\n" + "w" * 60, "}\n" * 900, "漢字" * 100 + "\n" + "漢" * 50, ""]
    for text in cases:
        assert chunking.packed_lines(text) == plain_children(text)
    assert chunking.tail("x" * 100 + "\n}", 20) == "x" * 100 + "\n}"


def test_embeddings_against_plain(spark, sf, documents):
    rows = {r.id: r.embedding for r in core.batch_embed(spark, sf).collect()}
    assert set(rows) == {i for i, t in documents.items() if re.sub(r"[\x00-\x20]", "", t or "")}
    for i, v in rows.items():
        assert np.allclose(v, plain_vector(documents[i]), atol=1e-6)
    assert embedding.hashing_embedder()([]).shape == (0, 64)


@pytest.mark.parametrize("at", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_index_recall(spark, at):
    """Every vector is in the index; of the exact answers it gives at least nine in ten."""
    exact = {(r.query_id, r.doc_id) for r in core.vec_multi_query_topk(spark, at).collect()}
    found = {(r.query_id, r.doc_id) for r in core.vec_topk_index(spark, at).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_split_documents_takes_the_set_up_way(spark, sf):
    docs = core.chunks(spark, sf).limit(20)
    of = embedding.hashing_embedder()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(chunking.split_documents(docs, of)) == rows(chunking.hierarchical_chunks(docs, of))
    assert rows(chunking.split_documents(docs, semantic=False)) == rows(chunking.fixed_chunks(docs))
    with pytest.raises(ValueError):
        chunking.split_documents(docs)


def test_table_functions(spark):
    chunking.register_functions(spark)
    text = "\n".join(f"line {i} of a text" for i in range(40))
    for name, of in (("chunk_lines", chunking.packed_lines), ("chunk_sentences", lambda t, n, o: chunking.fixed_groups(t.split("\n"), n, o))):
        got = spark.sql(f"select * from {name}('{text}', 30, 5)").orderBy("chunk_index").collect()
        assert [(r.chunk_index, r.content) for r in got] == list(enumerate(of(text, 30, 5))) and len(got) > 3
        assert spark.sql(f"select * from {name}('', 30, 5)").count() == 0


def test_batches_are_sliced_by_bytes():
    import pyarrow as pa

    from docloom import storage

    batch = pa.RecordBatch.from_pydict({"i": list(range(40)), "content": [b"x" * (storage.GIVEN // 10)] * 39 + [None]})
    own = list(storage.slices(batch, "content"))
    assert [i for b in own for i in b.column("i").to_pylist()] == list(range(40)) and max(map(len, own)) <= 11
    assert [len(b) for b in storage.slices(batch.slice(0, 0), "content")] == []
