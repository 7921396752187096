"""Named queries of the retrieval engine, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking, cooccurrence, embedding, fusion, graph, index, memo, pairs, postings, search, store, tombstones
from docloom.plans.retrieve import Retriever
from docloom.sources import files
from docloom.storage import shared_dir, spread, table
from docloom.streaming import ingest, tokens

QUESTIONS = ["启动open-webui的两种方式是什么？", "如何安装docker？", "docker怎么启动", "Spring AI有哪些特点？", "请问如何在k8s中部署redis?", "什么是Spring AI", "是什么意思", "怎么样", "如何", "", "  plain  words, kept ", "email about MySQL and contain", "使用教程 docker compose 部署"]
VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
KEYWORDS = ["the", "tion"]
DELETED_FILE = "src3"
#: Events of a stream of tokens in four files, of which each of two triggers takes two.
EVENTS = 8 << 20
PARTITIONS = "spark.sql.shuffle.partitions"


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, q string")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("text").alias("content"), F.lit(None).cast("string").alias("parent_content"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    row = vectors(spark, sf).filter(F.col("doc_id") == vec_id).first()
    return list(row["embedding"]) if row else []


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))


def deleted(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).filter(F.col("filename") == DELETED_FILE).select(F.col("id").alias("doc_id"))


Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def top_sql(where: str = "", threshold: float = 0.5) -> str:
    return f"""
with q as (select embedding::double[] as e from embeddings where vec_id = 0),
s as (select v.vec_id as doc_id, round((1 + list_cosine_similarity(v.embedding::double[], q.e)) / 2, 6) as score from embeddings v, q {where})
select doc_id, score, (row_number() over (order by score desc, doc_id))::int as rank from s where score >= {threshold} order by score desc, doc_id limit 20"""


@query(top_sql(threshold=0.0))
def vec_topk(spark, sf):
    return search.vector_top_k(vectors(spark, sf), query_vector(spark, sf, 0), 20, 0.0)


@query(top_sql(threshold=0.6))
def vec_topk_threshold(spark, sf):
    return search.vector_top_k(vectors(spark, sf), query_vector(spark, sf, 0), 20, 0.6)


@query(top_sql(where=f"where v.vec_id not in (select doc_id from documents where source = '{DELETED_FILE}')"))
def vec_topk_softdelete(spark, sf):
    return search.vector_top_k(vectors(spark, sf), query_vector(spark, sf, 0), 20, 0.5, deleted(spark, sf))


@query("""
with s as (select q.vec_id as query_id, v.vec_id as doc_id, round((1 + list_cosine_similarity(v.embedding::double[], q.embedding::double[])) / 2, 6) as score
           from embeddings q, embeddings v where q.vec_id % 50 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from s where score >= 0.5)
select query_id, doc_id, score, rank from r where rank <= 20""")
def vec_multi_query_topk(spark, sf):
    v = vectors(spark, sf)
    return search.multi_query_top_k(v, v.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "embedding"), 20)


@query()
def vec_topk_index(spark, sf):
    """The same questions to the approximate index, built over all vectors."""
    v = vectors(spark, sf)
    own = index.VectorIndex.build(v, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return own.search(spark, v.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "embedding"), 20)


@query()
def vec_topk_graph(spark, sf):
    """The same questions to the proximity graph of all vectors."""
    v = vectors(spark, sf)
    own = graph.GraphIndex.build(v, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    return own.search(spark, v.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "embedding"), 20, deleted=deleted(spark, sf))


LIKE = " or ".join(f"lower(text) like '%{k}%'" for k in KEYWORDS)


@query(f"select doc_id as id from documents where {LIKE} order by doc_id limit 40")
def kw_search(spark, sf):
    return search.keyword_hits(chunks(spark, sf), KEYWORDS, 40)


KEYWORD_SETS = [KEYWORDS, ["license"], ["2024"], ["lic_nse%the", "é%ñ"], ["ß", "xyz"]]


@query(" union all ".join(f"(select {i} as set_id, doc_id as id from documents where {' or '.join(f"lower(text) like '%{k}%'" for k in ks)} order by doc_id limit 40)" for i, ks in enumerate(KEYWORD_SETS)))
def kw_search_index(spark, sf):
    """Common and rare keywords, with and without wildcards, through the index."""
    own = postings.KeywordIndex.build(chunks(spark, sf), f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}")
    return reduce(DataFrame.unionByName, [own.hits(spark, ks, 40).select(F.lit(i).alias("set_id"), "id") for i, ks in enumerate(KEYWORD_SETS)])


@query(f"select id from (select doc_id as id from documents where (lower(text) like '%the%' or lower(text) like '%tion%') and doc_id not in (select doc_id from labels where toxic = 1) order by doc_id limit 40)")
def kw_search_growing(spark, sf):
    """The documents come in three batches by source, one of them twice; the first two become one index before the last
    comes. Toxic ones are deleted."""
    own = postings.GrowingIndex(f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64(F.coalesce("filename", F.lit(""))), F.lit(3))
    for batch in (0, 1, 1, 2):
        own.add(chunks(spark, sf).filter(part == batch), batch)
        if batch == 1:
            own.merge(spark)
    return own.hits(spark, KEYWORDS, 40, toxic(spark, sf))


@query("select doc_id as id, (contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int) as matched from documents")
def kw_match_count(spark, sf):
    return chunks(spark, sf).select("id", sum(F.contains(F.lower("content"), F.lit(k)).cast("int") for k in KEYWORDS).alias("matched"))


LISTS = f"""
lists as (
  select 0 as list_id, doc_id, score from (with q as (select embedding::double[] as e from embeddings where vec_id = 0), s as (select v.vec_id as doc_id, round((1 + list_cosine_similarity(v.embedding::double[], q.e)) / 2, 6) as score from embeddings v, q) select * from s where score >= 0.5 order by score desc, doc_id limit 20)
  union all
  select 1, doc_id, score from (with q as (select embedding::double[] as e from embeddings where vec_id = 7), s as (select v.vec_id as doc_id, round((1 + list_cosine_similarity(v.embedding::double[], q.e)) / 2, 6) as score from embeddings v, q) select * from s where score >= 0.5 order by score desc, doc_id limit 20)
  union all
  select 2, doc_id, 1.0 from (select doc_id from documents where {LIKE} order by doc_id limit 40)),
r as (select *, row_number() over (partition by list_id order by score desc, doc_id) as rn from lists),
fused as (select doc_id, max(score)::double as original_score, round(sum(1.0::double / (60 + rn)), 10) as rrf_score from r group by doc_id),
scored as (select *, round(original_score * (1 + 10 * rrf_score), 6) as final_score from fused)"""


def result_lists(spark, sf):
    v, c = vectors(spark, sf), chunks(spark, sf)
    own = [search.vector_top_k(v, query_vector(spark, sf, i), 20).select(F.lit(n).alias("list_id"), "doc_id", "score") for n, i in enumerate((0, 7))]
    own.append(search.keyword_hits(c, KEYWORDS, 40).select(F.lit(2).alias("list_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score")))
    return reduce(DataFrame.unionByName, own)


@query(f"with {LISTS} select * from scored")
def rrf_fuse(spark, sf):
    return fusion.reciprocal_rank_fusion(result_lists(spark, sf))


@query(f"with {LISTS} select d.doc_id as id, coalesce(s.final_score, 1.0) as final_score from documents d left join scored s using (doc_id)")
def score_attach_default(spark, sf):
    return fusion.attach_scores(chunks(spark, sf).select("id"), fusion.reciprocal_rank_fusion(result_lists(spark, sf)))


COVER = "((contains(lower(d.text), 'the')::int + contains(lower(d.text), 'tion')::int) / 2.0::double)"


@query(f"select * from (select d.doc_id as id, round(1.2::double * {COVER}, 6) as final_score from documents d) where final_score > 0")
def kw_adjust(spark, sf):
    docs = chunks(spark, sf).withColumn("final_score", F.lit(1.2))
    return fusion.adjust_by_keywords(docs, F.coalesce("parent_content", "content"), KEYWORDS).select("id", "final_score")


HYBRID = f"""{LISTS},
adjusted as (select d.doc_id as id, d.text as ctx, round(s.final_score * {COVER}, 6) as final_score from scored s join documents d using (doc_id)),
best as (select *, (row_number() over (order by final_score desc, id))::int as rank from adjusted where final_score > 0 order by final_score desc, id limit 20)"""


class _Fixed(Retriever):
    def keywords(self, question):
        return KEYWORDS


def retrieved(spark, sf):
    return _Fixed(chunks(spark, sf), vectors(spark, sf)).search("", [query_vector(spark, sf, i) for i in (0, 7)])


@query(f"with {HYBRID} select id, final_score, rank from best")
def hybrid_search(spark, sf):
    return retrieved(spark, sf).select("id", "final_score", "rank")


CONTEXT = f"with {HYBRID}, first as (select ctx, min(rank) as rank from best group by ctx), n as (select ctx, row_number() over (order by rank) as n from first), c as (select coalesce(string_agg('[' || n || '] ' || ctx || chr(10) || chr(10), '' order by n), '') as context from n)"


@query(f"{CONTEXT} select context from c")
def context_build(spark, sf):
    return fusion.context(retrieved(spark, sf))


@query(f"{CONTEXT} select '{fusion.RULES}' as system, '问题：what is it' || chr(10) || chr(10) || '参考资料：' || chr(10) || context || chr(10) || '请基于以上参考资料回答问题：' || chr(10) as prompt from c")
def prompt_build(spark, sf):
    return fusion.prompt("what is it", fusion.context(retrieved(spark, sf)))


@query("select doc_id as id, source as filename, text as content from documents where doc_id in (3, 5, 8, 999999999)")
def find_by_ids(spark, sf):
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 8, 999999999)], "id long")
    return chunks(spark, sf).join(F.broadcast(wanted), "id", "left_semi").select("id", "filename", "content")


@query("select doc_id as id, text as content, (row_number() over (order by doc_id) - 1)::int as chunk_index from documents where source = 'src1'")
def find_by_source(spark, sf):
    own = chunks(spark, sf).filter(F.col("filename") == "src1")
    return store.numbered(own, ["id"], "chunk_index").select("id", "content", F.col("chunk_index").cast("int").alias("chunk_index"))


@query("select event_type as filename, (row_number() over (order by max(ts) desc, event_type))::int as rank from events group by event_type")
def list_files_by_recency(spark, sf):
    return store.files_by_recency(table(spark, sf, "events").select(F.col("event_type").alias("filename"), F.col("ts").alias("upload_time")))


@query("select event_id, event_type as filename, ts as upload_time from events order by ts desc, event_id")
def list_all_ordered(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("filename"), F.col("ts").alias("upload_time")).orderBy(F.desc("upload_time"), "event_id")


@query("select (select count(*) from documents) as n_documents, (select count(*) from embeddings) as n_vectors")
def count_docs(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return n.join(F.broadcast(table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n_vectors"))))


@query("select vec_id, label from embeddings order by vec_id limit 50 offset 100")
def page_offset(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label").orderBy("vec_id").offset(100).limit(50)


GONE = f"(select doc_id from documents where source = '{DELETED_FILE}')"


@query(f"select distinct v.vec_id as doc_id from embeddings v left join (select * from documents where source <> '{DELETED_FILE}') d on v.vec_id = d.doc_id where d.doc_id is null")
def orphan_vectors(spark, sf):
    return store.orphans(vectors(spark, sf), store.delete_files(chunks(spark, sf), [DELETED_FILE]))


@query(f"select vec_id as doc_id, embedding[1] as first from embeddings where vec_id not in {GONE}")
def cascade_delete(spark, sf):
    return store.cascade(vectors(spark, sf), deleted(spark, sf)).select("doc_id", F.get("embedding", F.lit(0)).alias("first"))


@query(f"select vec_id as doc_id, embedding[1] as first from embeddings where vec_id not in {GONE} and vec_id % 7 <> 0")
def cascade_delete_bitmaps(spark, sf):
    """Two deletes as bitmaps of row positions, the table's files left as they are."""
    own = tombstones.Tombstones(f"{sf}/embeddings.parquet", f"{shared_dir(spark)}/tombstones-{uuid.uuid4().hex}")
    own.delete(spark, keys=deleted(spark, sf).withColumnRenamed("doc_id", "vec_id"))
    own.delete(spark, F.col("vec_id") % 7 == 0)
    return own.read(spark).select(F.col("vec_id").alias("doc_id"), F.get("embedding", F.lit(0)).alias("first"))


@query(f"select source as filename, count(*) as n from documents where source <> '{DELETED_FILE}' group by source")
def delete_by_filename(spark, sf):
    return store.delete_files(chunks(spark, sf), [DELETED_FILE]).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@query(f"select vec_id as doc_id, row_number() over (order by vec_id) - 1 as node_id from embeddings where vec_id not in {GONE}")
def compact_renumber(spark, sf):
    return store.compact(vectors(spark, sf), deleted(spark, sf))


@query("select doc_id as id, source as filename from documents where doc_id is null or doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)")
def delete_by_id(spark, sf):
    return store.delete_ids(chunks(spark, sf), toxic(spark, sf)).select("id", "filename")


@query(f"""with r as (select d.doc_id, d.source, (coalesce(d.source, '') = '{DELETED_FILE}')::int as batch, v.embedding is not null as has_vector from documents d left join embeddings v on v.vec_id = d.doc_id)
select row_number() over (order by batch, doc_id) - 1 as id, doc_id, source as filename, has_vector from r""")
def insert_batches(spark, sf):
    """Documents with their vectors in two batches, the second one twice: dense ids, and vectors of those that have one."""
    out = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = chunks(spark, sf).withColumnRenamed("id", "doc_id").join(vectors(spark, sf), "doc_id", "left")
    for batch in (0, 1, 1):
        store.insert(rows.filter((F.coalesce("filename", F.lit("")) == DELETED_FILE).cast("int") == batch), out, batch, ["doc_id"])
    held = spark.read.parquet(f"{out}/vectors").select(F.col("doc_id").alias("id"), F.lit(True).alias("has_vector"))
    return spark.read.parquet(f"{out}/chunks").join(held, "id", "left").select("id", "doc_id", "filename", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query(f"select vec_id as doc_id, (vec_id not in (select doc_id from documents where source = '{DELETED_FILE}' and doc_id is not null))::int as batch from embeddings where vec_id is not null and embedding is not null")
def insert_new_vectors(spark, sf):
    """The vectors of one file, then all of them twice: those that are held don't come again."""
    path, v = f"{shared_dir(spark)}/held-{uuid.uuid4().hex}", vectors(spark, sf)
    store.insert_new(v.join(deleted(spark, sf), "doc_id", "left_semi"), path, 0)
    for _ in range(2):
        store.insert_new(v.unionByName(v), path, 1)
    return spark.read.parquet(path).select("doc_id", F.col("batch").cast("int").alias("batch"))


@query(f"select vec_id as doc_id, row_number() over (order by vec_id) - 1 as node_id from embeddings where embedding is not null and vec_id in (select doc_id from documents where source <> '{DELETED_FILE}' or source is null)")
def compact_with_orphans(spark, sf):
    return store.compact_tables(chunks(spark, sf), vectors(spark, sf), deleted(spark, sf))[1].select("doc_id", "node_id")


@query(f"select *, case when total_vector_count > 0 then round(deleted_doc_ids_count / total_vector_count::double, 6) else 0.0 end as deletion_ratio from (select (select count(distinct doc_id) from {GONE}) as deleted_doc_ids_count, (select count(*) from embeddings) as total_vector_count)")
def deleted_stats(spark, sf):
    return store.deleted_stats(vectors(spark, sf), deleted(spark, sf))


@query("""select 'union' as op, doc_id as id from (select doc_id from documents union select vec_id from embeddings)
union all select 'difference', doc_id from (select doc_id from documents except select vec_id from embeddings)
union all select 'both', doc_id from (select doc_id from documents intersect select vec_id from embeddings)""")
def id_set_ops(spark, sf):
    a, b = chunks(spark, sf).select("id"), vectors(spark, sf).select(F.col("doc_id").alias("id"))
    parts = [("union", a.union(b).distinct()), ("difference", a.join(b, "id", "left_anti").distinct()), ("both", a.join(b, "id", "left_semi").distinct())]
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("op"), "id") for n, d in parts])


def estimate_sql(cjk: str, other: str) -> str:
    n = "(length(text) - length(regexp_replace(text, '[一-龥]', '', 'g')))"
    return f"select id, floor({n} * {cjk} + (length(text) - {n}) * {other})::bigint as tokens from (select doc_id as id, text from documents union all select * from (values {VALUES}) t(id, text))"


def texts(spark, sf):
    return chunks(spark, sf).select("id", F.col("content").alias("text")).union(questions(spark))


def estimate_of(f):
    return lambda spark, sf: texts(spark, sf).select("id", f(F.col("text")).alias("tokens"))


# The estimates count CJK characters; the pattern above removes them, so the SQL takes the difference in length.
for _name, _f, _w in (("token_estimate_a", text.token_estimate_a, ("0.5::double", "0.25::double")), ("token_estimate_b", text.token_estimate_b, ("0.7::double", "0.3::double"))):
    Q[_name], SQL[_name] = estimate_of(_f), estimate_sql(*_w)


@query(r"select id, i, line from (select doc_id as id, unnest(l) as line, unnest(range(len(l))) as i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') as l from documents))")
def line_split(spark, sf):
    return chunks(spark, sf).select("id", F.posexplode(text.lines(F.col("content"))).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


@query(r"select id, chunk_index, total_chunks, content from (select doc_id as id, unnest(l) as content, unnest(range(len(l))) as chunk_index, len(l) as total_chunks from (select doc_id, string_split(text, chr(10)) as l from documents)) where regexp_replace(content, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') <> ''")
def blank_filter_positions(spark, sf):
    parts = chunks(spark, sf).select("id", F.split("content", "\n").alias("l"))
    rows = parts.select("id", F.size("l").cast("long").alias("total_chunks"), F.posexplode("l").alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return files.non_blank(rows, "content")


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


CLEAN = sql_trim(rf"regexp_replace(regexp_replace(regexp_replace(q, '^({text.LEADING})\s*', ''), '{text.PUNCTUATION.replace(chr(39), chr(39) * 2)}', '', 'g'), '\s+', ' ', 'g')")
ASKED = f"(select * from (values {VALUES}) t(id, q) union all select item_id + 1000, text from benchmark)"
CLEANED = f"cleaned as (select id, q, {CLEAN} as c from {ASKED})"


RESTRUCTURED = f"""case
  when c like '%如何%' or c like '%怎么%' or c like '%怎样%' then {sql_trim("regexp_replace(c, '(如何|怎么样|怎么|怎样)', '', 'g')")}
  when c like '%是什么%' then {sql_trim("regexp_replace(c, '(是什么|是什么意思)[？?]?$', '')")}
  when c like '%有哪些%' or c like '%是哪些%' then {sql_trim(f"regexp_replace(c, '({text.LIST_ENDINGS})[？?]?$', '')")}
  else c end"""


@query(f"with {CLEANED} select id, c as cleaned from cleaned")
def query_clean(spark, sf):
    return asked(spark, sf).select("id", text.clean_query(F.col("q")).alias("cleaned"))


@query(f"""with {CLEANED},
made as (select id, q, c, {RESTRUCTURED} as r from cleaned)
select id, case when {sql_trim("q")} = '' then q when r = c or length(r) < floor(length(c) / 2.0) then c else r end as rewritten from made""")
def query_rewrite(spark, sf):
    return asked(spark, sf).select("id", text.rewrite(F.col("q")).alias("rewritten"))


TERMS = "[" + ", ".join(f"'{t}'" for t in text.CUSTOM_TERMS) + "]"
STOPS = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(text.STOP_WORDS)) + "]"
FOUND = f"list_filter({TERMS}, lambda t: contains(lower(q), lower(t)))"


def asked(spark, sf):
    return questions(spark).union(table(spark, sf, "benchmark").select(F.col("item_id") + 1000, "text"))


@query(f"select id, array_to_string({FOUND}, ',') as terms from {ASKED}")
def custom_terms(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.custom_terms(F.col("q")), ",").alias("terms"))


KEYS = f"list_transform(list_filter(list_concat(regexp_extract_all(lower(q), '{text.segments()}'), {FOUND}), lambda w: length(w) >= 2 and not list_contains({STOPS}, lower(w))), lambda w: lower(w))"


def keyword_sql(limit: str = "") -> str:
    """First-seen order: the position of a word's first occurrence."""
    return f"select id, coalesce(array_to_string(list_filter(ks, lambda k, i: list_position(ks, k) = i){limit}, ','), '') as keywords from (select id, {KEYS} as ks from {ASKED})"


@query(keyword_sql())
def core_keywords(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.core_keywords(F.col("q")), ",").alias("keywords"))


@query(keyword_sql("[1:10]"))
def tokenize(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.tokenize(F.col("q")), ",").alias("keywords"))


@query(f"select id, case when length(q) < 10 then 3 when length(q) <= 20 then 5 else 6 end as cap from {ASKED}")
def variant_cap(spark, sf):
    return asked(spark, sf).select("id", text.variant_cap(F.col("q")).alias("cap"))


def expand_sql() -> str:
    several = [f"case when {' or '.join(f"contains(q, '{w}')" for w in named)} then [{', '.join(f"every || ' {x}'" for x in many)}] else [] end" for named, many, _ in text.INTENTS]
    single = [f"case when {' or '.join(f"contains(q, '{w}')" for w in named)} then [{', '.join(f"terms[1] || ' {x}'" for x in one)}] else [] end" for named, _, one in text.INTENTS]
    verbs = "[" + ", ".join(f"'{w}'" for w in text.QUESTION_VERBS) + "]"
    join = lambda parts: f"list_filter(flatten([{', '.join(parts)}]), lambda x: x <> '')"
    return f"""
with t as (select id, q, list_filter(list_transform(regexp_extract_all(q, '[a-zA-Z][a-zA-Z0-9_-]*'), lambda x: lower(x)), lambda x: not list_contains({verbs}, x)) as terms from {ASKED}),
e as (select *, array_to_string(terms, ' ') as every from t),
p as (select id, case when len(terms) >= 2 then {join([*several, '[every]'])} when len(terms) = 1 then {join(single)} else [] end as p from e)
select id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:4] as phrases from p"""


@query(f"select id, coalesce(array_to_string(phrases, '|'), '') as phrases from ({expand_sql()})")
def expand_keywords(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.expand_keywords(F.col("q")), "|").alias("phrases"))


def merged_sql(tokens: str) -> str:
    """Terms in no other term: longest first, then as they came."""
    return f"""
with k as (select id, q, list_filter(ks, lambda k, i: list_position(ks, k) = i)[1:10] as ks from (select id, q, {KEYS} as ks from {tokens})),
m as (select id, q, list_filter(ks, lambda x: len(list_filter(ks, lambda y: y <> x and contains(y, x))) = 0) as kept, ks from k),
s as (select id, q, list_sort(list_transform(kept, lambda x: {{'n': -length(x), 'i': list_position(ks, x), 'x': x}})) as kept from m)
select id, q, list_transform(kept, lambda e: e.x) as terms from s"""


@query(f"select id, coalesce(array_to_string(terms, ','), '') as terms from ({merged_sql(ASKED)})")
def merge_terms(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.merge_terms(text.tokenize(F.col("q"))), ",").alias("terms"))


#: Stands in for the long list of characters that a caller gives.
DROPPED = "的了在是我有和就不人都启动"
SIMPLE = sql_trim(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '^({text.SIMPLE_LEADING})\s*', ''), '({text.SIMPLE_ENDINGS})\s*[？?]?$', ''), '[{DROPPED}]', ' ', 'g'), '{text.SIMPLE_PUNCTUATION}', ' ', 'g'), '\s+', ' ', 'g')")
LATIN = "array_to_string(regexp_extract_all(q, '[a-zA-Z0-9_-]+'), ' ')"


@query(f"select id, case when length(s) < 3 and {LATIN} <> '' then {LATIN} else s end as simple from (select id, q, {SIMPLE} as s from {ASKED})")
def simplify_query(spark, sf):
    return asked(spark, sf).select("id", text.simplify(F.col("q"), DROPPED).alias("simple"))


@query(f"""with a as (select id, q, {CLEAN} as c from {ASKED}),
made as (select id, q, c, {RESTRUCTURED} as r from a),
w as (select id, q, case when {sql_trim("q")} = '' then q when r = c or length(r) < floor(length(c) / 2.0) then c else r end as w from made),
m as ({merged_sql(ASKED)}),
x as ({expand_sql()}),
s as (select id, case when length(s) < 3 and {LATIN} <> '' then {LATIN} else s end as s from (select id, q, {SIMPLE} as s from {ASKED})),
v as (select id, q, list_filter(flatten([[q], [w], [case when len(terms) = 0 then q else array_to_string(terms, ' ') end], [s.s], phrases]), lambda y: y <> '') as v from w join m using (id, q) join x using (id) join s using (id))
select id, coalesce(array_to_string(list_filter(v, lambda y, i: list_position(v, y) = i)[1:(case when length(q) < 10 then 3 when length(q) <= 20 then 5 else 6 end)], '|'), '') as variants from v""")
def query_variants(spark, sf):
    return asked(spark, sf).select("id", F.array_join(text.variants(F.col("q"), DROPPED), "|").alias("variants"))


@query("select page_id, url as path, string_split(url, '/')[-1] as name from pages")
def basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), text.basename(F.col("url")).alias("name"))


#: File names of pages: the host's words are suffixes, and so are those that a page's number names.
NAMED = f"case when page_id % 2 = 0 then url else url || '.' || ['PDF', 'md', 'tar.gz', 'Html', 'txt', 'csv', 'json', 'htm', ''][page_id % 9 + 1] end"


@query(f"select path, case lower(string_split(path, '.')[-1]) {' '.join(f'''when '{k}' then '{v}' ''' for k, v in text.MIME.items())} else 'application/octet-stream' end as mime_type from (select {NAMED} as path from pages)")
def mime_from_suffix(spark, sf):
    ends = F.array(*map(F.lit, ["PDF", "md", "tar.gz", "Html", "txt", "csv", "json", "htm", ""]))
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("."), F.get(ends, (F.col("page_id") % 9).cast("int"))))
    return table(spark, sf, "pages").select(path.alias("path")).select("path", text.mime_of(F.col("path")).alias("mime_type"))


@query("select doc_id, n as file_size, case when n < 1 then 'empty' when n > 52428800 then 'too_large' when n > 10485760 then 'large' else 'ok' end as status from (select doc_id, (strlen(text) * 4096)::bigint as n from documents)")
def upload_validation(spark, sf):
    """As if each document were a file of 4096 times its size."""
    return files.validated(table(spark, sf, "documents").select("doc_id", (F.octet_length("text").cast("long") * 4096).alias("file_size")))


@query("select distinct 'src' || (item_id % 30) as filename from benchmark where 'src' || (item_id % 30) not in (select source from documents where source is not null)")
def dup_filename_guard(spark, sf):
    incoming = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 30).alias("filename")).distinct()
    return files.new_files(incoming, chunks(spark, sf))


@query("select label, pos::int as pos, round(avg(x::double), 6) as value from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) group by label, pos")
def centroid_by_label(spark, sf):
    return embedding.centroids(table(spark, sf, "embeddings"), "label")


RERANK = "with w as (select 'the of and tion thing' as q), s as (select doc_id as id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as p, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) as qs from documents, w), r as (select id, round(1.0 / (1.0 + exp(2.0 - 4.0 * (len(list_intersect(qs, p)) / greatest(len(qs), 1)::double))), 6) as rerank_score from s)"


@query(f"{RERANK} select id, rerank_score, (row_number() over (order by rerank_score desc, id))::int as rank from r order by rerank_score desc, id limit 20")
def rerank_overlap(spark, sf):
    return fusion.rerank(chunks(spark, sf), F.lit("the of and tion thing"), F.col("content"), 20).select("id", "rerank_score", "rank")


def questions_of(spark, sf):
    return table(spark, sf, "benchmark").filter(F.col("item_id") % 10 == 0).select("item_id", F.col("text").alias("question"))


@query()
def rerank_pairs(spark, sf):
    """Every tenth item of the benchmark as a question: of the documents with words of six or more letters in common, the 50
    with most of them are scored, and the ten best stay."""
    docs = table(spark, sf, "documents")
    own = pairs.PairScorer(pairs.Statistics.of(F.col("text"), docs))
    long = lambda c, n: F.explode(F.array_distinct(F.filter(pairs.words(F.col(c), n), lambda w: F.length(w) > 5))).alias("word")
    asked = questions_of(spark, sf)
    common = asked.select("item_id", long("question", pairs.QUESTION)).join(docs.select("doc_id", long("text", pairs.PASSAGE)), "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = lambda score: F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(score), "doc_id"))
    near = common.withColumn("place", place("n")).filter("place <= 50").select("item_id", "doc_id")
    scored = own.score(near.join(asked, "item_id").join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id"))
    return scored.withColumn("rank", place("rerank_score")).filter("rank <= 10").select("item_id", "doc_id", "rerank_score", "rank")


def families(spark, sf):
    """Chunks with parents: a document's first line within its whole text; every third document has no parent, and every
    fifth is its own."""
    id_, whole = F.col("id"), F.col("content")
    content = F.when(id_ % 5 == 0, whole).otherwise(F.substring_index(whole, "\n", 1))
    return chunks(spark, sf).select("id", "filename", content.alias("content"), F.when(id_ % 3 != 0, whole).alias("parent_content"))


FAMILIES = "(select doc_id as id, case when doc_id % 5 = 0 then text else split_part(text, chr(10), 1) end as content, case when doc_id % 3 <> 0 then text end as parent_content from documents)"
OF_FAMILY = "((contains(lower(ctx), 'the')::int + contains(lower(ctx), 'tion')::int) / 2.0::double)"
WITH_PARENTS = f"""hits as (select id, row_number() over (order by id) as rn from (select id from {FAMILIES} where lower(content) like '%the%' or lower(content) like '%tion%' order by id limit 40)),
adjusted as (select id, ctx, round(round(1 + 10 * round(1.0::double / (60 + rn), 10), 6) * {OF_FAMILY}, 6) as final_score from hits join (select id, coalesce(parent_content, content) as ctx from {FAMILIES}) using (id)),
best as (select *, (row_number() over (order by final_score desc, id))::int as rank from adjusted where final_score > 0 order by final_score desc, id limit 20)"""


def with_parents(spark, sf):
    return _Fixed(families(spark, sf), vectors(spark, sf)).search("", [])


@query(f"with {WITH_PARENTS} select id, final_score, rank, ctx from best")
def parent_search(spark, sf):
    return with_parents(spark, sf).select("id", "final_score", "rank", "ctx")


@query(f"with {WITH_PARENTS}, first as (select ctx, min(rank) as rank from best group by ctx), n as (select ctx, row_number() over (order by rank) as n from first) select coalesce(string_agg('[' || n || '] ' || ctx || chr(10) || chr(10), '' order by n), '') as context from n")
def parent_context(spark, sf):
    return fusion.context(with_parents(spark, sf))


@query(f"""with w as (select 'the of and tion thing' as q), p as (select distinct coalesce(parent_content, content) as passage from {FAMILIES}),
s as (select passage, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) as p, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) as qs from p, w),
best as (select passage, round(1.0 / (1.0 + exp(2.0 - 4.0 * (len(list_intersect(qs, p)) / greatest(len(qs), 1)::double))), 6) as rerank_score from s order by rerank_score desc, passage limit 20),
back as (select min(id) as id, rerank_score from best join {FAMILIES} f on f.content = best.passage group by passage, rerank_score)
select id, rerank_score, (row_number() over (order by rerank_score desc, id))::int as rank from back""")
def rerank_compat(spark, sf):
    return fusion.rerank(families(spark, sf), F.lit("the of and tion thing"), F.coalesce("parent_content", "content"), 20, "compat").select("id", "rerank_score", "rank")


@query("select doc_id as id, left(text, 150) as preview from documents")
def preview(spark, sf):
    return chunks(spark, sf).select("id", F.substring("content", 1, 150).alias("preview"))


# Characters that can't occur in the texts stand for a break, as this SQL has no look-around: after a stop and marks that
# close, before white space and what is no small letter; and after a Chinese stop.
@query(r"""with marked as (select doc_id as id, regexp_replace(regexp_replace(text, '([.?!]["'')\]}»”]{0,3})(\s+)', '\1' || chr(2) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g') as t from documents),
parts as (select id, string_split(regexp_replace(t, chr(2) || '\s+([^\s\p{Ll}])', chr(1) || '\1', 'g'), chr(1)) as p from marked),
clean as (select id, list_filter(list_transform(p, lambda x: regexp_replace(replace(x, chr(2), ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') as p from parts)
select id, unnest(range(len(p)))::int as i, unnest(p) as sentence from clean""")
def sentence_split(spark, sf):
    return chunks(spark, sf).select("id", F.posexplode(chunking.sentences(F.col("content"))).alias("i", "sentence"))


@query()
def chunk_fixed(spark, sf):
    return chunking.fixed_chunks(spread(chunks(spark, sf), "id"))


@query()
def chunk_semantic(spark, sf):
    return chunking.semantic_chunks(spread(chunks(spark, sf), "id"), embedding.hashing_embedder())


@query()
def chunk_hierarchical(spark, sf):
    return chunking.hierarchical_chunks(spread(chunks(spark, sf), "id"), embedding.hashing_embedder())


@query()
def batch_embed(spark, sf):
    return embedding.embed_texts(chunks(spark, sf).select("id", "content"), "content", embedding.hashing_embedder())


@query()
def batch_embed_learned(spark, sf):
    """The documents' texts by an embedder that is learned from all of them."""
    own = cooccurrence.embedder(cooccurrence.fit(table(spark, sf, "documents"), "text", dim=32), 32)
    return embedding.embed_texts(chunks(spark, sf).select("id", "content"), "content", own)


FILLED = "(select distinct text from {t} where regexp_replace(text, '[\\x00-\\x20]', '', 'g') <> '')"


@query(f"""with d as {FILLED.format(t="documents")}, b as {FILLED.format(t="benchmark")}
select 1::bigint as run, 0::bigint as hits, count(*)::bigint as misses from d
union all select 2, (select count(*) from d), count(*) from b where text not in (select text from d)""")
def embed_memo(spark, sf):
    """The documents' texts, then those and the benchmark's: what the second run finds embedded."""
    own, of = memo.Memo(f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}"), embedding.hashing_embedder()
    docs = table(spark, sf, "documents").select("text")
    own.embed(docs, "text", of, 1)
    own.embed(docs.union(table(spark, sf, "benchmark").select("text")), "text", of, 2)
    return own.counts(spark)


@query("select vec_id as doc_id, len(embedding) * 4 as n_bytes, true as same from embeddings")
def vector_codec_roundtrip(spark, sf):
    raw = vectors(spark, sf).withColumn("raw", embedding.encode_vector("embedding"))
    return raw.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), (embedding.decode_vector("raw") == F.col("embedding")).alias("same"))


@query()
def html_to_text(spark, sf):
    return files.html_column(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "text")


def ingested(spark: SparkSession, sf: str) -> str:
    """The folder of a store that took the pages as a stream of files."""
    pages = f"{sf}/pages.parquet"
    # A pattern, as a stream takes a path without one for a folder.
    raw = spark.readStream.schema(spark.read.parquet(pages).schema).parquet(f"{sf}/pages.parque[t]")
    files_ = raw.filter("html is not null").select(F.format_string("page%d.html", "page_id").alias("path"), F.octet_length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest.ingest_stream(spark, files_, out, embedding.hashing_embedder())
    return out


@query()
def stream_ingest(spark, sf):
    """Chunks of all committed batches."""
    return ingest.committed(spark, ingested(spark, sf), "chunks").select("filename", "chunk_index", "total_chunks", "content")


@query(r"""with p as (select 'page' || page_id || '.html' as task_id, regexp_replace(html, '<[^>]*>|\s', '', 'g') <> '' as kept from pages where html is not null),
steps as (select * from (values (10, 'READING', null), (30, 'PARSING', true), (60, 'EMBEDDING', true), (70, 'STORING', true), (80, 'STORED', true), (100, 'COMPLETED', true), (100, 'REJECTED', false)) s(progress, status, wanted))
select task_id, progress, status from p join steps on wanted is null or wanted = kept""")
def ingest_progress(spark, sf):
    """What a client sees of every file: a row per step."""
    return ingest.progress(spark, ingested(spark, sf)).select("task_id", "progress", "status")


@query("select conv_id || '-' || turn as task_id, ceil(length(coalesce(text, '')) / 7.0)::bigint as n_tokens, coalesce(text, '') as answer from conversations where conv_id is not null and turn is not null")
def token_stream(spark, sf):
    """The turns of conversations as answers whose tokens come twice and in any order."""
    out, text_ = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", F.coalesce("text", F.lit(""))
    turns = table(spark, sf, "conversations").filter("conv_id is not null and turn is not null").select(F.concat_ws("-", "conv_id", "turn").alias("task_id"), text_.alias("text"))
    parts = F.concat(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0)), F.array(F.lit(None).cast("string")))
    sent = spread(turns, "task_id").select("task_id", F.posexplode(parts).alias("seq", "text")).withColumn("kind", F.when(F.col("text").isNull(), "done").otherwise("token"))
    twice = sent.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("h", F.xxhash64("task_id", "seq", "kind", "copy"))
    # Files of bounded size; a task's events lie in four of them, so it is met as often however many there are.
    groups = -(-int(turns.agg(F.sum(2 * F.ceil(F.length("text") / 7) + 2)).first()[0] or 1) // EVENTS)
    file = (F.pmod(F.xxhash64("task_id"), F.lit(groups)) * 4 + F.pmod("h", F.lit(4))).cast("int")
    events = twice.repartitionById(4 * groups, file).sortWithinPartitions("h").select("task_id", F.col("seq").cast("long").alias("seq"), "kind", "text", F.timestamp_seconds(F.lit(1_700_000_000)).alias("time"))
    events.write.parquet(f"{out}/events")
    arriving = spark.readStream.schema(tokens.EVENTS).option("maxFilesPerTrigger", 2 * groups).parquet(f"{out}/events")
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(max(int(before), 4 * groups)))  # of the state; a million events for each of its tasks
    try:
        tokens.run(spark, arriving, f"{out}/answers", f"{out}/checkpoint")
    finally:
        spark.conf.set(PARTITIONS, before)
    return tokens.read_answers(spark, f"{out}/answers").filter("event = 'complete'").select("task_id", F.col("place").alias("n_tokens"), F.col("text").alias("answer"))


QUERIES = Q
