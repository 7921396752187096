"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns what lies there then."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans.queries import sql_trim
from docloom.storage import shared_dir
from jobs import passage_store, purge


def config(name: str) -> dict:
    return json.loads(Path(__file__).with_name(name).read_text())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_passage_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        passage_store.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/passages", f"{folder}/checkpoint", **config("passage_store.json"))
    return passage_store.read_store(spark, f"{folder}/passages")


SIZE, STEP = (c := config("passage_store.json"))["size"], c["size"] - c["overlap"]
_CJK = "(length(content) - length(regexp_replace(content, '[一-龥]', '', 'g')))"
# A break is marked by characters that can't occur in the texts, as this SQL has no look-around.
JOB1_SQL = rf"""
with docs as (
  select distinct on (doc_id) doc_id, coalesce(text, '') as text, nullif(source, '') as source, strlen(coalesce(text, '')) as file_size from documents where doc_id is not null),
judged as (
  select *, case when file_size < 1 then 'empty' when file_size > 52428800 then 'too_large' when {sql_trim("text")} = '' then 'blank' when file_size > 10485760 then 'large' else 'ok' end as status from docs),
marked as (select *, regexp_replace(regexp_replace(text, '([.?!]["'')\]}}»”]{{0,3}})(\s+)', '\1' || chr(2) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g') as t from judged),
parts as (select *, case when status in ('ok', 'large') then string_split(regexp_replace(t, chr(2) || '\s+([^\s\p{{Ll}}])', chr(1) || '\1', 'g'), chr(1)) else [] end as p from marked),
clean as (select *, list_filter(list_transform(p, lambda x: {sql_trim("replace(x, chr(2), '')")}), lambda x: x <> '') as s from parts),
counted as (select *, case when len(s) = 0 then 0 else greatest(1, ceil((len(s) - {SIZE - STEP}) / {STEP}::double)) end::int as n from clean),
rows as (
  select doc_id, file_size::bigint as file_size, i::int as chunk_index, n as total_chunks, array_to_string(s[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') as content, status, source
  from (select *, unnest(range(n)) as i from counted where n > 0)
  union all select doc_id, file_size::bigint, null, 0, null, status, source from counted where n = 0)
select *, floor({_CJK} * 0.5::double + (length(content) - {_CJK}) * 0.25::double)::bigint as tokens from rows
"""


def job2_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        purge.run(spark, *[f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "embeddings")], out, **config("purge.json"))
    chunks, vectors, report = (purge.read_output(spark, out, name) for name in ("chunks", "vectors", "report"))
    null = lambda kind: F.lit(None).cast(kind)
    counts = F.concat_ws(",", "n_read", "n_kept", "n_by_source", "n_by_label", "n_vectors")
    rows = chunks.select(F.lit("chunks").alias("output"), "id", "source", "content", null("long").alias("node_id"), null("int").alias("shard"), null("int").alias("dims"))
    rows = rows.unionByName(vectors.select(F.lit("vectors").alias("output"), F.col("doc_id").alias("id"), null("string").alias("source"), null("string").alias("content"), "node_id", "shard", F.size("embedding").alias("dims")))
    return rows.unionByName(report.select(F.lit("report").alias("output"), null("long").alias("id"), "source", counts.alias("content"), null("long").alias("node_id"), null("int").alias("shard"), null("int").alias("dims")))


_PURGE = config("purge.json")
_SOURCES = ", ".join(f"'{s}'" for s in _PURGE["sources"])
_LABELS = " or ".join(f"{c} = 1" for c in _PURGE["label_columns"])
JOB2_SQL = f"""
with docs as (
  select doc_id, text, nullif(source, '') as source,
         case when source in ({_SOURCES}) then 'source' when doc_id in (select doc_id from labels where {_LABELS}) then 'label' end as reason
  from documents),
gone as (select distinct doc_id from docs where reason is not null and doc_id is not null),
kept as (select * from docs where reason is distinct from 'source' and (doc_id is null or doc_id not in (select doc_id from gone))),
vectors as (select vec_id, embedding, row_number() over (order by vec_id) - 1 as node_id from embeddings where embedding is not null and vec_id in (select doc_id from kept)),
held as (select source, count(*) as n from (select doc_id, min(source) as source from kept group by doc_id) k join vectors v on v.vec_id = k.doc_id group by source),
counts as (
  select source, count(*) as n_read, count(*) filter (where reason is distinct from 'source' and (doc_id is null or doc_id not in (select doc_id from gone))) as n_kept,
         count(*) filter (where reason = 'source') as n_by_source, count(*) filter (where reason is distinct from 'source' and doc_id in (select doc_id from gone)) as n_by_label
  from docs group by source)
select 'chunks' as output, doc_id as id, source, text as content, null::bigint as node_id, null::int as shard, null::int as dims from kept
union all select 'vectors', vec_id, null, null, node_id, (node_id % {_PURGE["shards"]})::int, len(embedding)::int from vectors
union all select 'report', null, c.source, concat_ws(',', n_read, n_kept, n_by_source, n_by_label, coalesce(h.n, 0)), null, null, null
from counts c left join held h on c.source is not distinct from h.source
"""

QUERIES = {"job1_passage_store": job1_passage_store, "job2_purge": job2_purge}
SQL = {"job1_passage_store": JOB1_SQL, "job2_purge": JOB2_SQL}
