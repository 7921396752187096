"""The queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import conversation_trie, decontaminate, language, line_dedup, mtree, near_dup, packing, secrets, sentence_pieces, spotsigs, token_counts, warc
from docloom.storage import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_IDS = {"tokenizer": BYTE_BPE, "ranks": BYTE_BPE_RANKS, "pattern": public_tokenizers.PATTERN}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from docs),
keyed as (
  select doc_id, line, i,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
frequent as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select d.doc_id, d.line, d.i, f.k is not null and f.keeper <> d.doc_id as gone from keyed d left join frequent f on d.k = f.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE_RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE_IDS, end_id=2, capacity=1024)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.expr("(id - 1) div 2").alias("page_id"), "status", F.expr("response_id div 2").alias("response_page_id"), "digest", joined.alias("headers"))


OP5_SQL = r"""
with bare as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages),
parts as (
  select page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
         regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*(/[^?]*)', 1), '/index\.html?$', '/'), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda a: a <> '' and not regexp_matches(a, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) as args
  from bare),
keyed as (
  select page_id, sha1(coalesce(html, '')) as digest, host || path || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as key from parts),
found as (
  select r.page_id, r.digest as own, max(w.page_id) as response from keyed r left join keyed w
    on r.key = w.key and (w.page_id < r.page_id + 7 or (w.page_id = r.page_id + 7 and w.page_id * 2 < r.page_id * 2 + 1))
  group by all)
select f.page_id, case when f.response is null then 'missing' when left(f.own, 16) <> left(k.digest, 16) then 'mismatch' else 'resolved' end as status,
       case when left(f.own, 16) = left(k.digest, 16) then f.response end as response_page_id,
       case when left(f.own, 16) = left(k.digest, 16) then k.digest end as digest,
       case when left(f.own, 16) = left(k.digest, 16) then 'content-type=text/html;date=' || (f.page_id + 7) || ';etag=W/"' || left(f.own, 16) || '"' end as headers
from found f left join keyed k on f.response = k.page_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs.filter(~held_out).select("text", "lang"))
    out = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


_ANCHORS = ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS)))


def _signatures_sql(source: str) -> str:
    """CTE steps from ``source`` (doc_id, text) to (doc_id, text, s)."""
    return f"""
  select doc_id, text, case when len(s) > 0 then s when text = '' then []::varchar[]
         when len(w) > 0 then ['=' || array_to_string(w, ' ')] else ['=' || text] end as s
  from (
    select doc_id, text, w, list_distinct(list_filter(list_transform(c, lambda x, i: case when x.spot then x.w || ' ' || c[i + 1].w end), lambda x: x is not null)) as s
    from (
      select doc_id, text, w, list_filter(list_transform(w, lambda x, i: {{'w': x, 'spot': i > 1 and list_contains([{_ANCHORS}], w[i - 1])}}), lambda x: not list_contains([{_ANCHORS}], x.w)) as c
      from (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {source})))"""


_JACCARD = "len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_LIKENESS = f"case when len({{a}}) = 0 and len({{b}}) = 0 then 1.0 when len({{a}}) = 0 or len({{b}}) = 0 then 0.0 else {_JACCARD} end"
_PRINT = "sha256(array_to_string(list_sort({a}), chr(10)))"
OP7_SQL = f"""
with base as (
  select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over (order by doc_id desc), first_value(coalesce(text, '')) over (order by doc_id desc)) as next_text
  from documents),
changed as (
  select doc_id, next_text, text as own, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) as text from base),
a as ({_signatures_sql("base")}),
b as ({_signatures_sql("changed")}),
c as ({_signatures_sql("(select doc_id, next_text as text from base)")})
select a.doc_id, length(a.text)::bigint as n_chars, sha256(b.text) as edited_sha256,
       {_PRINT.format(a="a.s")} as fingerprint, {_PRINT.format(a="b.s")} as edited_fingerprint,
       {_LIKENESS.format(a="a.s", b="b.s")} as near_edited, {_LIKENESS.format(a="a.s", b="c.s")} as near_next,
       near_edited >= 0.75 as alike_edited, near_next >= 0.75 as alike_next
from a join b using (doc_id) join c using (doc_id)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP11_SQL = f"""
with items as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select item_id, least(len(w), 10) as m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as p
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from items where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
places as (
  select r, k, m, array_to_string(w[k : k + m - 1], ' ') as p
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as k from docs cross join (select distinct m from windows) where len(w) >= m)),
found as (select distinct r, k, m, p from places semi join windows using (m, p)),
hits as (select r, count(distinct i) as n from (select r, unnest(range(k, k + m)) as i from found) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item_id::varchar as item from found join windows using (m, p) where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hits.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from docs left join hits using (r) left join named using (r)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation_trie.shared_prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 4 as h
  from (select distinct conv_id from turns)),
rebuilt as (
  select conv_id, role, text, row_number() over (partition by conv_id order by part, i) as d
  from (select c.conv_id, 0 as part, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.i <= c.h
        union all select c.conv_id, 1, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.i > c.h)),
paths as (
  select conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
         sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' order by d) over (partition by conv_id order by d)) as id
  from rebuilt
  union all select conv_id, 0, 0, 'root' from convs),
nodes as (select d, id, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from paths group by d, id),
lasts as (select conv_id, max(d) as d from paths group by conv_id),
ends as (select d, id, string_agg(conv_id::varchar, ',' order by conv_id) as ids from paths join lasts using (conv_id, d) group by d, id),
linked as (select n.*, p.id as parent_id, q.conv_id as parent_conv_id from nodes n left join paths p on p.conv_id = n.conv_id and p.d = n.d - 1 left join nodes q on q.d = p.d and q.id = p.id),
children as (select d - 1 as d, parent_id as id, count(*) as n from linked where parent_id is not null group by all),
sums as (
  select p.d, p.id, count(*) filter (where c.n is null) as n_leaves, sum((n.n_convs - 1) * n.words) as saved
  from nodes n left join children c using (d, id) join paths p on p.conv_id = n.conv_id and p.d <= n.d group by p.d, p.id)
select n.conv_id, n.d::bigint as depth, parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from linked n left join children c using (d, id) join sums s using (d, id) left join ends e using (d, id)
"""


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_pack_sequences, op4_exact_topk, op5_warc_revisits, op6_language_id, op7_spot_signatures, op8_token_counts, op9_near_duplicates, op10_sentence_pieces, op11_decontaminate, op12_conversation_trie)}
SQL = {"op1_line_dedup": OP1_SQL, "op4_exact_topk": OP4_SQL, "op5_warc_revisits": OP5_SQL, "op7_spot_signatures": OP7_SQL, "op11_decontaminate": OP11_SQL, "op12_conversation_trie": OP12_SQL}
