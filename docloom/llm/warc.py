"""Resolution of not-modified revisit records.

A revisit says that a page was as it had been. It is matched to the latest earlier full response of the same canonical
URL (an as-of join), its validators are checked against that response's, and its headers are merged into the
response's as far as a not-modified answer may change them.

The as-of join is two-level, so that one URL may hold any share of the records: time is cut into ranges at approximate
percentiles; within a URL and range the last full response is carried forward; ranges without one take that of an
earlier range of the URL. Payloads don't take part: the result names the response's id and digest.

Validators: with ETags on both sides these must be equal (weakly: a ``W/`` prefix is ignored), else with Last-Modified
on both sides those must be equal; a payload digest on both sides must be equal too; without any validator on one side
the match stands, marked ``unchecked``.

Defined results: status is ``resolved``, ``unchecked``, ``mismatch`` or ``missing`` (no earlier full response); only the
first two take the response's digest and the merged headers. A null URL or time matches nothing. Among records of one
URL and time the order is by id, so a response counts as earlier than a revisit with a larger id. A null digest or
header map is as if absent. Repeated rows are records of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time at least and at most, in between one for RANGE_ROWS records; a URL may have records in all of them.
FEWEST, MOST, RANGE_ROWS = 64, 4096, 2_000_000
#: Ranges whose bounds are compared with a time one after the other.
SIDE = 64
# Header fields that a not-modified answer may replace.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary"]
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Scheme-less host and path in one form: lower-case host without ``www.`` and default port, no fragment, no slash
    or ``index.html`` at the end, query arguments sorted without those that only track."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    args = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda a: (a != "") & ~a.rlike(TRACKING))
    query = F.array_join(F.array_sort(args), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """A header map with lower-case names; of names that then agree the last stays."""
    entries = F.map_entries(headers)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers with those of the revisit that a not-modified answer may replace."""
    ours, theirs = F.coalesce(response, F.create_map().cast("map<string,string>")), F.coalesce(revisit, F.create_map().cast("map<string,string>"))
    new = F.map_filter(theirs, lambda k, v: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(ours, lambda k, v: ~F.map_contains_key(new, k)), new)


def as_of(records: DataFrame) -> DataFrame:
    """``records`` (key, ts, id, full, carried) with ``found``: ``carried`` of the latest earlier full row of the key."""
    many, cuts = records.agg(F.count(F.lit(1)), F.expr(f"percentile_approx(ts, array({', '.join(f'{(i + 1) / MOST!r}D' for i in range(MOST - 1))}), 10000)")).first()
    step = MOST // min(MOST, max(FEWEST, 1 << (many // RANGE_ROWS).bit_length()))
    cuts = (cuts or [])[step - 1 :: step]
    literals = lambda own: F.array(*[F.lit(c) for c in own]) if own else F.array().cast(f"array<{dict(records.dtypes)['ts']}>")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("ts")))
    # Every SIDE-th bound first, then those between two of them.
    groups = F.array(*[literals(cuts[lo : lo + SIDE]) for lo in range(0, max(1, len(cuts)), SIDE)])
    rows = records.withColumn("group", below(literals(cuts[SIDE - 1 :: SIDE][: (len(cuts) - 1) // SIDE])))
    rows = rows.withColumn("range", F.col("group") * SIDE + below(F.get(groups, F.col("group")))).drop("group")
    value = F.when(F.col("full"), F.struct("carried"))
    within = Window.partitionBy("key", "range").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(value, ignorenulls=True).over(within))
    last = rows.filter("full").groupBy("key", "range").agg(F.max_by("carried", F.struct("ts", "id")).alias("c"))
    slots = rows.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n")).join(last, ["key", "range"], "left")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST rows a key
    slots = slots.select("key", "range", F.last("c", ignorenulls=True).over(before).alias("far"))
    return rows.join(slots, ["key", "range"]).withColumn("found", F.coalesce("near.carried", "far")).drop("near", "far", "range")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(id, url, ts, status, response_id, digest, headers) for each revisit.

    ``records``: id, url, ts (a number or timestamp), type (``response`` or ``revisit``), digest, headers (a map).
    """
    headers = lower_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = records.select("id", "url", "ts", "digest", headers.alias("headers"), canonical_url(F.col("url")).alias("key"), (F.col("type") == "response").alias("full"))
    carried = F.struct("id", "digest", "headers")
    matched = as_of(rows.filter("key is not null and ts is not null").withColumn("carried", carried)).filter("not full").drop("carried")
    loose = rows.filter("(key is null or ts is null) and not full").withColumn("found", F.lit(None).cast("struct<id:bigint,digest:string,headers:map<string,string>>"))
    out = matched.select(loose.columns).unionByName(loose)
    tag = lambda c: F.regexp_replace(c["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    etags, dates, digests = tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"], F.col("digest") == F.col("found.digest")
    first = F.coalesce(etags, dates)
    status = F.when(F.col("found").isNull(), "missing").when(~F.coalesce(first, F.lit(True)) | ~F.coalesce(digests, F.lit(True)), "mismatch").when(first.isNull() & digests.isNull(), "unchecked").otherwise("resolved")
    good = F.col("status").isin("resolved", "unchecked")
    out = out.withColumn("status", status)
    return out.select("id", "url", "ts", "status", F.when(good, F.col("found.id")).alias("response_id"), F.when(good, F.col("found.digest")).alias("digest"), F.when(good, merged(theirs, mine)).alias("headers"))


def records_of_pages(pages: DataFrame, spread: int = 7) -> DataFrame:
    """Crawl records of a page table: each page is fetched whole at its id and asked for again ``spread`` later, when
    the server answers that it is as before. The second answer's ETag is that of the page itself."""
    digest = F.sha1(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    whole = pages.select((F.col("page_id") * 2).alias("id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("type"), digest.alias("digest"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("id"), "url", (F.col("page_id") + spread).alias("ts"), F.lit("revisit").alias("type"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Type"), F.lit("x/y"), F.lit("Date"), (F.col("page_id") + spread).cast("string")).alias("headers"))
    return whole.unionByName(again)
