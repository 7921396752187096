"""The prefix trie of conversations: nodes, members, and sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns (role and text). Its digest is made of a sum: each turn adds four numbers of
32 bits, hashed from its place and content, so the digests of all prefixes of a conversation are running sums, and a
conversation of any length is dealt over many tasks. A prefix less its last turn's numbers is its parent: edges need no
sorting of conversations. Texts don't move: a turn leaves the scan as the SHA-256 of role and text and a number of words.

Sums over subtrees take as many rounds as the depth has binary digits. In round k each node of a depth of 2^k or more
points to the ancestor 2^k above; the sums of those that point to a node are added to it, then each takes its target's
pointer. Nodes that are too high to point on leave the rounds. Many nodes may point to one: sums are combined before
they move, and the pointers of targets that more than a thousandth of all nodes ask for, at most a thousand of them, are
broadcast (``follow``).

Defined results: turns are in order of ``turn``, null first; turns with the same number in order of the SHA-256 of role
and text; repeated rows are turns of their own. A null role or text is empty. Rows with a null conv_id are no
conversation. Other columns don't matter. A very long text is hashed in the task that reads it. An empty table gives no
nodes. A conversation may have up to 2^31 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import cut

LANES = [f"p{i}" for i in range(4)]
#: A target that more than this share of the rows point to is met by broadcast.
HOT = 1000
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) without texts."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256))
    return conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` with their range and the place within conversation and range, and (conv_id, range, before, total): the
    turns of the conversation in earlier ranges and in all. A conversation may span any number of ranges."""
    # Written, as dealing by range reads its rows twice: texts are read once.
    own = cut(turns, "hashed").withColumn("row", F.monotonically_increasing_id())
    ranged = cut(own.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest", "row").withColumn("range", F.spark_partition_id()), "turns")
    slots = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "digest", "row"))
    return ranged.select("conv_id", "range", place.cast("long").alias("place"), "digest", "words"), slots


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, range, depth, total, digest, words) from turns (conv_id, turn, digest, words)."""
    rows, slots = placed(turns)
    return rows.join(slots, ["conv_id", "range"]).select("conv_id", "range", (F.col("before") + F.col("place")).alias("depth"), "total", "digest", "words")


def rebuilt(turns: DataFrame, head: Column, base: Column, longest: int) -> DataFrame:
    """(conv_id, range, depth, total, digest, words) where the first ``head`` turns of each conversation, ``longest`` at
    most, are those of conversation ``base`` (both columns of conv_id); those stand in range -1. A conversation that
    keeps no turn has one row of depth 0."""
    own = cut(numbered(turns), "numbered")
    convs = own.groupBy("conv_id").agg(F.first("total").alias("n")).withColumns({"h": head, "base": base})
    first = own.filter(F.col("depth") <= longest).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "words"))).alias("lead"))
    convs = convs.join(first.select(F.col("conv_id").alias("base"), "lead"), "base", "left")
    convs = convs.withColumn("lead", F.slice(F.coalesce("lead", F.array().cast(first.schema["lead"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("total", F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(convs.withColumn("shift", F.size("lead") - F.col("h")).select("conv_id", "h", "shift", "total", "lead"), "conversations")
    lead = convs.select("conv_id", "total", F.explode_outer("lead").alias("t")).filter("t is not null or total = 0")
    lead = lead.select("conv_id", F.lit(-1).alias("range"), F.coalesce("t.depth", F.lit(0)).alias("depth"), "total", "t.digest", "t.words")
    # By conversation and range, so that a long conversation's turns stay apart.
    slots = own.groupBy("conv_id", "range").agg(F.lit(1).alias("one")).join(convs.drop("lead"), "conv_id").drop("one")
    rest = own.drop("total").join(slots, ["conv_id", "range"]).filter("depth > h")
    return lead.unionByName(rest.select("conv_id", "range", (F.col("depth") + F.col("shift")).alias("depth"), "total", "digest", "words"))


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, total, id, parent, words): a row per conversation and prefix, and one of depth 0 for each without
    turns; id is the prefix's digest."""
    mask = F.lit(0xFFFFFFFF)
    hashes = [F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "depth", "digest")) for k in range(2)]
    rows = turns.withColumns({"a": hashes[0], "b": hashes[1]})
    rows = rows.select("conv_id", "range", "depth", "total", "words", *[c.alias(n) for n, c in zip(LANES, (F.col("a").bitwiseAND(mask), F.shiftrightunsigned("a", 32), F.col("b").bitwiseAND(mask), F.shiftrightunsigned("b", 32)), strict=True)])
    rows = cut(rows, "lanes")
    sums = rows.groupBy("conv_id", "range").agg(*[F.sum(x).alias(x) for x in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "range", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in LANES])
    so_far = Window.partitionBy("conv_id", "range").orderBy("depth")
    rows = rows.select("*", *[F.sum(x).over(so_far).alias(f"{x}_here") for x in LANES]).join(sums, ["conv_id", "range"])
    own = [F.col(f"{x}_here") + F.col(f"{x}_before") for x in LANES]
    parent = [c - F.col(x) for c, x in zip(own, LANES, strict=True)]
    of = lambda depth, lanes: F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))
    return rows.select("conv_id", "depth", "total", of(F.col("depth"), own).alias("id"), F.when(F.col("depth") > 0, of(F.col("depth") - 1, parent)).alias("parent"), F.when(F.col("depth") > 0, F.col("words")).otherwise(0).alias("words"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, n_convs, words) of all nodes, the root with them."""
    root = F.unhex(F.md5(F.lit(",".join("0" * 5))))
    below = rows.filter("depth > 0").groupBy("id").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    # Each conversation has one row of depth 1, or one of depth 0.
    top = rows.filter("depth <= 1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    return below.unionByName(top.select(root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words")))


def follow(rows: DataFrame, key: str, targets: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` joined to ``targets`` (``key`` and more), inner. ``asked`` (``key``, n) tells how many rows ask for each:
    the at most HOT targets that more than a HOT-th of all rows ask for are broadcast, the others meet by shuffle."""
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = asked.filter(F.col("n") * HOT > total).select(key)
    hot = cut(targets.join(F.broadcast(hot), key).withColumn("_hot", F.lit(True)), "hot")
    out = rows.join(F.broadcast(hot.select(key, "_hot")), key, "left")
    few = out.filter("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), key)
    return few.unionByName(out.filter("_hot is null").drop("_hot").join(targets, key))


def rolled_up(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(id, *values): for each node of ``nodes`` (id, parent, depth, *values) the sums over its subtree."""
    done, k = [nodes.filter("depth = 0").select("id", *values)], 0
    live = nodes.filter("depth > 0").select("id", F.col("parent").alias("jump"), "depth", *values)
    while deepest >= 1 << k:
        step, beyond = 1 << k, 2 << k
        # What each target is given; its own depth is that of any node that points to it, less the step.
        given = cut(live.groupBy("jump").agg(F.count(F.lit(1)).alias("n"), (F.first("depth") - step).alias("depth"), *[F.sum(v).alias(v) for v in values]), "given")
        done += [live.filter(F.col("depth") < beyond).select("id", *values), given.filter(F.col("depth") < beyond).select(F.col("jump").alias("id"), *values)]
        if deepest >= beyond:
            deep = live.filter(F.col("depth") >= beyond)
            more = given.filter(F.col("depth") >= beyond).select(F.col("jump").alias("id"), *[F.col(v).alias(f"{v}_more") for v in values])
            grown = deep.join(more, "id", "left").select("id", "jump", "depth", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values])
            targets = live.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
            asked = given.filter(F.col("depth") >= step).select("jump", "n")
            live = cut(follow(grown, "jump", targets, asked).select("id", F.col("next").alias("jump"), "depth", *values), "live")
        k += 1
    return reduce(DataFrame.union, done).groupBy("id").agg(*[F.sum(v).alias(v) for v in values])


def ends_of(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256): of each node with conversations that end there, the SHA-256 of their numbers, ascending and
    joined by commas. Ranges of numbers are joined where they lie; a node's ranges then pass through its hash in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, convs, texts = b.column("id").to_pylist(), b.column("conv_id").to_pylist(), pc.cast(b.column("conv_id"), pa.string()).to_pylist()
            first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            yield pa.RecordBatch.from_pydict({"id": [ids[i] for i in first], "first": [convs[i] for i in first], "text": [",".join(texts[i:j]) for i, j in zip(first, [*first[1:], len(ids)], strict=True)]}, pa.schema([("id", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, schema = None, None, pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
        for b in batches:
            made = []
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key == last:
                    state.update(b"," + text.encode())
                else:
                    if last is not None:
                        made.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"id": [k for k, _ in made], "ends_sha256": [h for _, h in made]}, schema)
        if last is not None:
            yield pa.RecordBatch.from_pydict({"id": [last], "ends_sha256": [state.hexdigest()]}, schema)

    ends = rows.filter("depth = total").select("id", F.col("conv_id").cast("long").alias("conv_id"))
    parts = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(joined, "id binary, first long, text string")
    return parts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of ``turns`` (conv_id, range, depth, total, digest, words): id, parent, conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(members(turns), "members")
    nodes = cut(nodes_of(rows), "nodes")
    children = cut(nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "children")
    counted = nodes.join(children.select(F.col("parent").alias("id"), "n"), "id", "left").withColumn("n_children", F.coalesce("n", F.lit(0))).drop("n")
    counted = cut(counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "counted")
    sums = rolled_up(counted, ["n_leaves", "saved_tokens"], counted.agg(F.max("depth")).first()[0] or 0)
    own = counted.drop("n_leaves", "saved_tokens", "words").join(sums, "id").join(ends_of(rows), "id", "left")
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = follow(own.filter("parent is not null"), "parent", parents, children)
    out = below.unionByName(own.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast(dict(nodes.dtypes)["conv_id"])))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of ``conversations`` (conv_id, turn, role, text) as they are."""
    return trie(numbered(turns_of(conversations)))


def shared_prefix_trie(conversations: DataFrame, group: int = 20, longest: int = 3) -> DataFrame:
    """``trie`` of conversations rebuilt so that some share their beginnings: a conversation's first turns, up to
    ``longest`` by the CRC of its number, are those of the conversation ``group`` divides its number down to."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    return trie(rebuilt(turns_of(conversations), head, F.col("conv_id") - F.col("conv_id") % group, longest))
