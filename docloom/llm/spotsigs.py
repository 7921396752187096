"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot is a content word that directly follows a common word (an anchor). Its signature is the chain of CHAIN content
words from there on, anchors skipped. A text's fingerprint stands for its set of distinct signatures; two texts are
compared by the Jaccard similarity of their sets. A search (``similar``) partitions sets by length, in steps of the
similarity asked for: sets that are not in the same or neighbouring partitions can't reach it and never meet, and of those
that do only ones that share a signature of their prefixes are compared. The likeness of two given texts
(``fingerprints``) is the similarity itself.

Signatures are read off the text by three regular expressions (to words and spaces, anchors to marks, chains after
marks), so that a row holds its text a few times and its signatures, but never an array of its words.

Defined results: a null text is empty and has an empty set. A text with words but without any complete chain has one
signature, its whole sequence of words; a text without words has itself. Two empty sets have similarity 1, one empty
set has 0 with any other. Equal sets have equal fingerprints. Rows with one doc_id follow each other in the order of
their texts' hashes, equal rows next to each other; null ids come last. The next of the last document is the first, of a
table's only row itself. An empty table gives an empty table. Other columns, whatever their names, don't matter and
aren't returned. A very long text costs memory in proportion to its length, in the task that reads it alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import cut

# Frequent function words of English, German, Spanish and French.
ANCHORS = """
a an and are as at be by for from has he in is it of on or that the this to was were will with
das dem den der des die ein eine er es im ist mit nicht sich sie und von zu
de del el en la las lo los no para por que se un una y
au aux ce des du est et il la le les ne pas pour qui sur une
""".split()
CHAIN = 2
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
#: Texts at least that similar are alike.
LEAST = 0.75


def one_of(words: set[str]) -> str:
    """A pattern of ``words`` that looks at each character once."""
    rest = "|".join(c + one_of({w[1:] for w in words if w[:1] == c}) for c in sorted({w[0] for w in words if w}))
    return f"(?:{rest})" + "?" * ("" in words) if rest else ""


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with the array ``out`` of the distinct signatures of column ``text``, which holds no null."""
    words, marked = f"{out}_words", f"{out}_marked"
    df = df.withColumn(words, F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))
    df = df.withColumn(marked, F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f"(?<= ){one_of(set(ANCHORS))} ", "*"))
    word = "[^ *]++"
    chains = F.regexp_extract_all(marked, F.lit(rf"\*(?=({word}{(r' \**+' + word) * (chain - 1)}))"), F.lit(1))
    df = df.withColumn(out, F.array_distinct(F.transform(chains, lambda x: F.replace(x, F.lit("*"), F.lit("")))))
    whole = F.when(F.trim(words) != "", F.trim(words)).otherwise(F.col(text))
    return df.withColumn(out, F.when((F.size(out) > 0) | (F.col(text) == ""), F.col(out)).otherwise(F.array(F.concat(F.lit("="), whole)))).drop(words, marked)


def fingerprint(signatures: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(signatures), "\n"), 256)


def partition(n: Column, least: float) -> Column:
    """Number of the length partition; sets of similarity ``least`` lie in the same or neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones have 1."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(both / (n + m - both))


def likeness(a: Column, b: Column, least: float) -> Column:
    """``jaccard``, but 0 below ``least``; elements are compared only where the sets' length partitions, and then their
    lengths, let them reach it."""
    n, m = F.size(a), F.size(b)
    apart = (F.abs(partition(n, least) - partition(m, least)) > 1) | (F.least(n, m) < F.lit(least) * F.greatest(n, m))
    value = jaccard(a, b)
    return F.when(apart, 0.0).otherwise(F.when(value >= least, value).otherwise(0.0))


def similar(queries: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(query_id, doc_id, likeness) of documents at least that similar to a query; both inputs are (doc_id, text).

    The sets are written first: the optimiser would copy their expression into filters and evaluate it per element.

    A query's sets meet documents by one signature and length partition. A set of n must share one of any
    n - ceil(least * n) + 1 signatures with a partner, so that many of each query's are joined, in hash order.
    """
    sets = lambda df: cut(with_signatures(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "s").select("doc_id", "s"), "spots")
    whole, d0 = sets(queries).toDF("query_id", "qs"), sets(docs)
    q = whole.withColumn("p", partition(F.size("qs"), least))
    prefix = F.expr(f"slice(array_sort(qs, (a, b) -> case when xxhash64(a) < xxhash64(b) then -1 when xxhash64(a) > xxhash64(b) then 1 else 0 end), 1, size(qs) - cast(ceil({least} * size(qs) - 1e-9) as int) + 1)")
    q = q.select("query_id", "qs", F.explode_outer(prefix).alias("sig"), "p").filter("sig is not null").select("query_id", "qs", "sig", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1)).alias("p"))
    d = d0.withColumn("p", partition(F.size("s"), least)).select("doc_id", "s", "p", F.explode_outer("s").alias("sig"))
    met = q.join(d, ["sig", "p"]).select("query_id", "doc_id", likeness(F.col("qs"), F.col("s"), least).alias("likeness"))
    # Two empty sets have no signature to meet by; they are alike.
    none = whole.filter(F.size("qs") == 0).select("query_id", F.size("qs").alias("n")).join(d0.filter(F.size("s") == 0).select("doc_id", F.size("s").alias("n")), "n").select("query_id", "doc_id", F.lit(1.0).alias("likeness"))
    return met.filter(F.col("likeness") >= least).unionByName(none).distinct()


def links(rows: DataFrame) -> DataFrame:
    """(k, h, before_k, before_h) for every row of ``rows`` (k, h), which has no row twice, and the row before it in
    descending k, then ascending h; before the first one is the last.

    No text moves here. Rows are dealt by ranges, whose number does not depend on the data; only the last row of each
    range is looked at across ranges.
    """
    ranged = cut(rows.select("k", "h").repartitionByRange(F.desc("k"), "h").withColumn("block", F.spark_partition_id()), "ranges")
    lasts = ranged.groupBy("block").agg(F.max(F.struct((-1 - F.col("k")).alias("k"), "h")).alias("last"))
    order = Window.orderBy("block")  # over the ranges, not the rows
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("block", F.coalesce(F.lag("last").over(order), F.last("last").over(everywhere)).alias("last"))
    own = Window.partitionBy("block").orderBy(F.desc("k"), "h")
    led = ranged.withColumns({"before_k": F.lag("k").over(own), "before_h": F.lag("h").over(own)}).join(F.broadcast(lasts), "block")
    first = F.col("before_k").isNull()
    return led.select("k", "h", F.when(first, -1 - F.col("last.k")).otherwise(F.col("before_k")).alias("before_k"), F.when(first, F.col("last.h")).otherwise(F.col("before_h")).alias("before_h"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document in descending doc_id, after the last one the first.

    Each text is dealt by (k, h), the id and its hash, and from there to the row before it: it moves twice in all, and
    meets the other in joins of one row with one row; no task holds a range of texts.
    """
    text = F.coalesce("text", F.lit(""))
    no_id = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    repeated = not rows.groupBy("k", "h").count().filter("count > 1").isEmpty()
    if repeated:
        rows = cut(rows.groupBy("k", "h").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies")), "rows")
    # Both joins read ``rows`` as they are, so that they share one exchange. Texts are dealt at any size, as what follows
    # takes much more time than its bytes tell; a broadcast one would leave it to the few tasks that read the links.
    moved = rows.join(links(rows).hint("merge"), ["k", "h"]).select(F.col("before_k").alias("k"), F.col("before_h").alias("h"), F.col("text").alias("next_text"))
    out = rows.join(moved.hint("merge"), ["k", "h"])
    if repeated:  # a copy is followed by the next copy, the last one by another row
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("next_text", F.when(F.col("copy") < F.col("copies"), F.col("text")).otherwise(F.col("next_text")))
    return out.select(F.when(F.col("k") != no_id, F.col("k")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document: what they are, how like
    they are, and whether that makes them alike."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for text, out in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_signatures(rows, text, out)
    rows = rows.withColumns({"near_edited": jaccard(F.col("own"), F.col("changed")), "near_next": jaccard(F.col("own"), F.col("following"))})
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        (F.col("near_edited") >= LEAST).alias("alike_edited"),
        (F.col("near_next") >= LEAST).alias("alike_next"),
    )
