"""Answers from streams of tokens: any order, repeats, restarts, errors, silence."""

import datetime
import random

import pandas as pd
import pytest

from docloom.streaming import tokens

START = datetime.datetime(2024, 1, 1)


def frame(events):
    return pd.DataFrame(events, columns=["seq", "kind", "text"])


def whole(rows):
    """The parts of an answer's rows, by event."""
    return {e: [(n, t) for k, n, t in rows if k == e] for e in ("token", "line", "complete", "error")}


@pytest.mark.parametrize("seed", range(30))
def test_any_order(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab\n é") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))]
    events = [(i, "token", t) for i, t in enumerate(parts)] + [(len(parts), "done", None)]
    events = [*events, *rng.choices(events, k=5), (-1, "token", "no"), (3, "odd", "no")]
    rng.shuffle(events)
    state, rows = None, []
    while events:  # in several batches, the state between them as it is kept
        n = rng.randint(1, len(events))
        own = tokens.Answer(state)
        rows += own.take(frame(events[:n]))
        state, events = own.state(), events[n:]
    answer = "".join(parts)
    lines = answer.split("\n")
    got = whole(rows)
    assert got["token"] == list(enumerate(parts)) and got["complete"] == [(len(parts), answer)] and not got["error"]
    assert got["line"] == list(enumerate(lines if lines[-1] else lines[:-1]))
    assert tokens.Answer(state).take(frame([(0, "token", "again"), (1, "done", None)])) == []


def test_error_after_its_tokens():
    own = tokens.Answer(None)
    assert own.take(frame([(2, "error", "broken"), (1, "token", "b"), (3, "token", "beyond")])) == []
    assert whole(own.take(frame([(0, "token", "a")]))) == {"token": [(0, "a"), (1, "b")], "line": [], "complete": [], "error": [(2, "broken")]}


def put(spark, folder, events, seconds=0):
    rows = [(*e, START + datetime.timedelta(seconds=seconds)) for e in events]
    spark.createDataFrame(rows, tokens.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, batch=1):
    arriving = spark.readStream.schema(tokens.EVENTS).option("maxFilesPerTrigger", batch).parquet(f"{tmp_path}/in")
    before = spark.conf.get(tokens.PROVIDER)
    tokens.run(spark, arriving, f"{tmp_path}/out", f"{tmp_path}/marks")
    assert spark.conf.get(tokens.PROVIDER) == before
    return sorted(tuple(r) for r in tokens.read_answers(spark, f"{tmp_path}/out").collect())


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    rng = random.Random(2)
    events = []
    for task in range(40):
        n = rng.randint(0, 6)
        events += [(f"t{task}", i, "token", rng.choice(["x", "a\n", "", None])) for i in range(n)]
        events += [(f"t{task}", n, "done", None)] if task % 10 else []
    events = [*events, *rng.choices(events, k=40), (None, 0, "token", "lost")]
    rng.shuffle(events)
    put(spark, f"{tmp_path}/in", events[: len(events) // 2])
    first = run(spark, tmp_path)
    put(spark, f"{tmp_path}/in", events[len(events) // 2 :])
    rows = run(spark, tmp_path)
    assert set(first) <= set(rows) and len(set(rows)) == len(rows)
    want = {tuple(r) for r in tokens.plain(spark.read.schema(tokens.EVENTS).parquet(f"{tmp_path}/in")).collect()}
    assert {(t, n, x) for t, e, n, x in rows if e == "complete"} == want and len(want) == 36
    assert {t for t, e, _, _ in rows if e == "complete"} == {f"t{i}" for i in range(40) if i % 10}
    assert run(spark, tmp_path) == rows, "a run without events adds no row"


def test_silence_ends_a_task(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a", 0, "token", "one\ntwo"), ("a", 2, "token", "never"), ("b", 0, "token", "x"), ("b", 1, "done", None)])
    put(spark, f"{tmp_path}/in", [("c", 0, "token", "later")], 100)
    put(spark, f"{tmp_path}/in", [("c", 1, "token", " still")], 400)
    put(spark, f"{tmp_path}/in", [("c", 2, "done", None)], 410)
    rows = run(spark, tmp_path)
    assert [r for r in rows if r[0] == "a"] == [("a", "error", 1, "timeout"), ("a", "line", 0, "one"), ("a", "token", 0, "one\ntwo")]
    assert [r for r in rows if r[0] == "b" and r[1] in ("complete", "error")] == [("b", "complete", 1, "x")]
    assert sum(r[0] == "c" and r[1] in ("complete", "error") for r in rows) >= 1


def test_files_of_events_stay_small(spark, sf, monkeypatch):
    """More events make more files, not larger ones, and a task's events lie in four of them."""
    from pyspark.sql import functions as F

    from docloom.plans import queries as core

    seen = []
    monkeypatch.setattr(core, "EVENTS", 2000)
    monkeypatch.setattr(core.tokens, "run", lambda spark, events, out, checkpoint: seen.append(out.removesuffix("/answers")))
    monkeypatch.setattr(core.tokens, "read_answers", lambda spark, out: spark.createDataFrame([], core.tokens.ROWS))
    core.token_stream(spark, sf)
    events = spark.read.parquet(f"{seen[0]}/events").withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in events.groupBy("file").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2000
    assert max(r["n"] for r in events.groupBy("task_id").agg(F.count_distinct("file").alias("n")).collect()) <= 4


def test_triggers_do_not_grow(spark, sf, monkeypatch):
    """More events make more files, of which two triggers take half each; the state has a row a bucket, not a task."""
    from docloom.plans import queries as core

    ran, own = [], core.tokens.run
    partitions = spark.conf.get(core.PARTITIONS)
    monkeypatch.setattr(core, "EVENTS", 2000)
    monkeypatch.setattr(core.tokens, "run", lambda spark, events, out, checkpoint: ran.append((own(spark, events, out, checkpoint, buckets=5), spark.conf.get(core.PARTITIONS))))
    got = sorted(tuple(r) for r in core.token_stream(spark, sf).collect())
    texts = [(f"{r.conv_id}-{r.turn}", r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.conv_id is not None and r.turn is not None]
    assert got == sorted((task, -(-len(text) // 7), text) for task, text in texts)
    query, of_state = ran[0]
    took = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(took) == 2 and [p["stateOperators"][0]["numRowsTotal"] for p in took] == [5, 5]
    assert int(of_state) > 8 and spark.conf.get(core.PARTITIONS) == partitions


def test_tasks_of_one_bucket(spark, tmp_path):
    """A task ends in time while others of its bucket go on, and a checkpoint keeps its number of buckets."""
    put(spark, f"{tmp_path}/in", [("a", 0, "token", "one\ntwo"), ("a", 2, "token", "never"), ("b", None, "done", None), ("b", 0, "token", None), ("b", 1, "done", None), ("c", 0, "token", "x")])
    for seconds in (100, 200, 300):
        put(spark, f"{tmp_path}/in", [("c", seconds // 100, "token", "y")], seconds)
    put(spark, f"{tmp_path}/in", [("c", 4, "done", None)], 310)
    events = lambda: spark.readStream.schema(tokens.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tokens.run(spark, events(), f"{tmp_path}/out", f"{tmp_path}/marks", buckets=1)
    rows = sorted(tuple(r) for r in tokens.read_answers(spark, f"{tmp_path}/out").collect())
    assert [r for r in rows if r[1] in ("complete", "error")] == [("a", "error", 1, "timeout"), ("b", "complete", 1, ""), ("c", "complete", 4, "xyyy")]
    assert [(t, n, x) for t, e, n, x in rows if e == "line"] == [("a", 0, "one"), ("c", 0, "xyyy")]
    put(spark, f"{tmp_path}/in", [("c", 5, "token", "z")], 320)
    with pytest.raises(Exception, match="1 buckets, not in 2"):
        tokens.run(spark, events(), f"{tmp_path}/out", f"{tmp_path}/marks", buckets=2)
