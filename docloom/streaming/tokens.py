"""Answers put together from a stream of their tokens.

A model's answer arrives as events of a task: tokens numbered from 0, then ``done`` with their number, or ``error`` with a
message in place of a number that would follow. Events may come late, in any order and several times. Per task, in state
that a checkpoint keeps, those that came early wait; what follows the last token seen goes out at once. Rows that come out:

``token``     each token once, in order; ``place`` is its number
``line``      a line of the answer, as soon as its end is seen or the answer is complete; ``place`` counts lines
``complete``  the whole answer, when all its tokens are there; ``place`` is their number
``error``     the message of the error event, or ``timeout``; ``place`` is the number of tokens that went out

After ``complete`` or ``error`` no event of the task makes a row, as long as its state is kept, for ``timeout`` after
its last event in event time. A task that hears nothing for that long ends in the ``timeout`` error, with what went out
before. Events without task, of another kind, or with a negative number make no row; a null token is empty. Of two tokens
with one number the first that came counts. An answer without tokens is complete and has no line.

A call of Python and the state that it gets cost milliseconds, a task's own work microseconds. So tasks go together, by
hash, in ``buckets``: a bucket has one state, that of its tasks, and one time at which the first of them may end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "task_id string, seq long, kind string, text string, time timestamp"
ROWS = "task_id string, event string, place long, text string"
TASK = "task_id string, latest long, next long, total long, lines long, closed boolean, answer string, line string, error string, seqs array<long>, tokens array<string>"
STATE = f"buckets long, tasks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in TASK.split(', '))}>>"
#: Buckets; a checkpoint keeps its tasks by their number.
BUCKETS = 2048
#: Rows that go out at once, at least.
FRAME = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Answer:
    """What is known of one task."""

    def __init__(self, state: tuple | None):
        self.next, self.total, self.lines, self.closed, self.answer, self.line, self.error, seqs, tokens = state or (0, None, 0, False, "", "", None, [], [])
        self.early = dict(zip(seqs or [], tokens or [], strict=True))

    def state(self) -> tuple:
        return (self.next, self.total, self.lines, self.closed, self.answer, self.line, self.error, list(self.early), list(self.early.values()))

    def take(self, events: pd.DataFrame) -> list[tuple[str, int, str]]:
        """Rows that these events bring."""
        for seq, kind, text in zip(events["seq"].tolist(), events["kind"].tolist(), events["text"].tolist(), strict=True):
            if seq == seq and seq is not None:
                self.hear(int(seq), kind, text if isinstance(text, str) else "")
        return self.ready()

    def hear(self, seq: int, kind: str, text: str) -> None:
        if self.closed or seq < 0:
            return
        if kind == "token":
            if seq >= self.next:
                self.early.setdefault(seq, text)
        elif kind in ("done", "error") and self.total is None:
            self.total, self.error = seq, text if kind == "error" else None

    def ready(self) -> list[tuple[str, int, str]]:
        """Rows that what was heard allows."""
        if self.closed:
            return []
        rows = []
        while self.next in self.early and (self.total is None or self.next < self.total):
            token = self.early.pop(self.next)
            rows.append(("token", self.next, token))
            self.next += 1
            self.answer += token
            *whole, self.line = (self.line + token).split("\n")
            for line in whole:
                rows.append(("line", self.lines, line))
                self.lines += 1
        if self.next == self.total:
            if self.error is None:
                rows += [("line", self.lines, self.line)] if self.line else []
                rows.append(("complete", self.next, self.answer))
            else:
                rows.append(("error", self.next, self.error))
            self.close()
        return rows

    def close(self) -> None:
        self.closed, self.answer, self.line, self.early = True, "", "", {}


def ordering(timeout_ms: int, buckets: int) -> Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What is done with a bucket: its tasks take their events, then those end that have heard nothing for the timeout."""

    def put_together(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        were, kept = state.get if state.exists else (buckets, [])
        if were != buckets:
            raise ValueError(f"the checkpoint keeps its tasks in {were} buckets, not in {buckets}")
        tasks, latest, rows = {}, {}, []
        for task, last, *own in kept:
            tasks[task], latest[task] = Answer(tuple(own)), last
        for events in () if state.hasTimedOut else chunks:
            heard = {}
            for task, seq, kind, text, ms in zip(*(events[c].tolist() for c in ("task_id", "seq", "kind", "text", "ms")), strict=True):
                own = heard.get(task)
                if own is None:
                    own = heard[task] = tasks.setdefault(task, Answer(None))
                own.hear(seq, kind, text)
                if ms > latest.setdefault(task, ms):
                    latest[task] = ms
            rows += [(task, *row) for task, own in heard.items() for row in own.ready()]
            if len(rows) >= FRAME:
                yield framed(rows)
                rows = []
        now = state.getCurrentWatermarkMs()
        for task in [task for task in tasks if latest[task] + timeout_ms <= now]:
            own = tasks.pop(task)
            if not own.closed:
                rows.append((task, "error", own.next, "timeout"))
        if rows:
            yield framed(rows)
        if tasks:
            state.update((buckets, [(task, latest[task], *own.state()) for task, own in tasks.items()]))
            state.setTimeoutTimestamp(min(latest[task] for task in tasks) + timeout_ms)
        else:
            state.remove()

    return put_together


def framed(rows: list[tuple[str, str, int, str]]) -> pd.DataFrame:
    task, event, place, text = zip(*rows, strict=True)
    words = lambda own: pd.Series(own, dtype=object)
    return pd.DataFrame({"task_id": words(task), "event": words(event), "place": pd.Series(place, dtype="int64"), "text": words(text)})


def answers(events: DataFrame, timeout_seconds: int = 120, late_seconds: int = 60, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream of ``events`` (task_id, seq, kind, text, time)."""
    known = events.filter("task_id is not null and time is not null and kind in ('token', 'done', 'error')")
    marked = known.withWatermark("time", f"{late_seconds} seconds")
    dealt = marked.select(F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket"), "task_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "kind", F.coalesce("text", F.lit("")).alias("text"), F.unix_millis("time").alias("ms"), "time")
    return dealt.groupBy("bucket").applyInPandasWithState(ordering(1000 * timeout_seconds, buckets), ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, timeout_seconds: int = 120, late_seconds: int = 60, buckets: int = BUCKETS):
    """Put together what has come, append it to the table ``out``, and return the finished query."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = answers(events, timeout_seconds, late_seconds, buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return query


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(out)


def plain(events: DataFrame) -> DataFrame:
    """(task_id, place, text) of complete answers of a table of events: what the stream gives, if it hears of each task
    without too long a pause."""
    tokens = events.filter("kind = 'token' and seq >= 0").groupBy("task_id", "seq").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    whole = tokens.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    done = events.filter("kind = 'done' and seq >= 0").groupBy("task_id").agg(F.first("seq").alias("place"))
    met = done.join(whole, "task_id", "left").withColumn("t", F.filter(F.coalesce("t", F.array().cast(whole.schema["t"].dataType)), lambda x: x["seq"] < F.col("place")))
    return met.filter(F.size("t") == F.col("place")).select("task_id", "place", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
