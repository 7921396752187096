"""Column functions on query and document texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading question phrases, in the order in which they are tried.
LEADING = "如何在|怎么|怎样|如何|请问|帮我|教我|告诉我|我想了解|我想知道"
# Punctuation removed from queries.
PUNCTUATION = "[?？。！，,、；:：\"\"''（）()]"
# Endings of list questions, longest first.
LIST_ENDINGS = "都有哪些规则|都有哪些特点|都有哪些特征|都有哪些|都是哪些|有哪些规则|有哪些特点|有哪些特征|有哪些|是哪些"
# Technical terms that are keywords wherever they occur.
CUSTOM_TERMS = "华为云 阿里云 腾讯云 百度云 云桌面 云计算 云服务 docker Docker kubernetes Kubernetes k8s ollama Ollama langchain LangChain spring Spring boot Boot ai AI mysql MySQL postgres PostgreSQL h2 H2 redis Redis elasticsearch Elasticsearch".split()
# Stop words of keyword extraction.
STOP_WORDS = """
的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 它 他 她 什么 怎么 为什么 如何
中 与 及 等 等等 或 或者 但 但是 而 如果 因为 所以 虽然 然后 接着 之后 之前
吗 呢 吧 啊 呀 哦 嘛 呗 哪 哪些 哪个 哪里 哪儿 哪位 几个 几种 几类 几点 谁 何时 什么时候 多久 多远 多少 多少个
从 向 往 朝 对 对于 关于 至于 被 把 让 给 使 令 并且 而且 此外 另外 同时
非常 特别 极其 十分 相当 比较 稍微 现在 已经 曾经 正在 将要 马上 立刻
提供 进行 实现 完成 执行 操作 可以 能够 应该 必须 做
""".split()
# Phrases at the beginning and at the end of a question that a simplified query goes without.
SIMPLE_LEADING = "如何在|怎么|怎样|如何|请问|帮我|教我|什么是|是什么|两种方式|的方法|的步骤|有哪些|包括哪些|具体是"
SIMPLE_ENDINGS = "是什么|是什么意思|有哪些|包括哪些|具体是"
# Punctuation that a simplified query has spaces for.
SIMPLE_PUNCTUATION = "[?？。！，,、；:：]"
# Words that name an intent, and what a query with several terms, or with one, is extended by.
INTENTS = [
    (["安装", "部署", "配置"], ["install", "安装"], ["install", "setup", "deploy"]),
    (["启动", "运行", "开始"], ["start", "启动"], ["serve", "run", "start"]),
    (["使用", "方法", "教程"], ["usage", "使用方法"], ["usage", "tutorial", "guide"]),
]
# English words that are no technical terms.
QUESTION_VERBS = "what how why when where who the is are was were be been being have has had do does did will would could should may might can shall".split()
MIME = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "csv": "text/csv", "json": "application/json"}


def trim_all(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def clean_query(c: Column) -> Column:
    out = F.regexp_replace(c, rf"^({LEADING})\s*", "")
    return trim_all(F.regexp_replace(F.regexp_replace(out, PUNCTUATION, ""), r"\s+", " "))


# Question words that a statement goes without, and how a question for a thing ends.
HOW, WHAT = "(如何|怎么样|怎么|怎样)", "(是什么|是什么意思)[？?]?$"


def restructure(c: Column) -> Column:
    """A question as a statement: question words removed by the first rule that applies."""
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in ws])
    return (
        F.when(has("如何", "怎么样", "怎么", "怎样"), trim_all(F.regexp_replace(c, HOW, "")))
        .when(has("是什么"), trim_all(F.regexp_replace(c, WHAT, "")))
        .when(has("有哪些", "是哪些"), trim_all(F.regexp_replace(c, f"({LIST_ENDINGS})[？?]?$", "")))
        .otherwise(c)
    )


def rewrite(c: Column) -> Column:
    """The restructured query, or the cleaned one if less than half would be left."""
    cleaned = clean_query(c)
    made = restructure(cleaned)
    short = F.length(made) < F.floor(F.length(cleaned) / 2)
    return F.when(c.isNull() | (trim_all(c) == ""), c).when((made == cleaned) | short, cleaned).otherwise(made)


def token_estimate(c: Column, cjk: float, other: float) -> Column:
    n = F.length(F.regexp_replace(c, "[^一-龥]", ""))
    return F.coalesce(F.floor(n * F.lit(cjk) + (F.length(c) - n) * F.lit(other)), F.lit(0)).cast("long")


def token_estimate_a(c: Column) -> Column:
    return token_estimate(c, 0.5, 0.25)


def token_estimate_b(c: Column) -> Column:
    return token_estimate(c, 0.7, 0.3)


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), trim_all), lambda x: x != "")


def custom_terms(c: Column) -> Column:
    """Listed terms that occur in the text, whatever their case, in the list's order."""
    return F.filter(F.array(*map(F.lit, CUSTOM_TERMS)), lambda t: F.contains(F.lower(c), F.lower(t)))


def segments(dictionary: list[str] | None = None) -> str:
    """A pattern of words: Latin ones; of Chinese characters the longest word of the dictionary that begins here, else
    the next two. The dictionary holds the listed terms, the stop words and what is given."""
    known = [w for w in dict.fromkeys([*CUSTOM_TERMS, *STOP_WORDS, *(dictionary or [])]) if all("一" <= x <= "龥" for x in w)]
    return "|".join(["[a-z0-9][a-z0-9_.+#@&-]*", *sorted(known, key=len, reverse=True), "[一-龥][一-龥]?"])


def core_keywords(c: Column, dictionary: list[str] | None = None) -> Column:
    """Words and listed terms of two or more characters, lower case, without stop words, first seen first."""
    words = F.concat(F.regexp_extract_all(F.lower(c), F.lit(segments(dictionary)), F.lit(0)), custom_terms(c))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(STOP_WORDS)), F.lower))


def tokenize(c: Column, limit: int = 10) -> Column:
    return F.slice(core_keywords(c), 1, limit)


def variant_cap(c: Column) -> Column:
    return F.when(F.length(c) < 10, 3).when(F.length(c) <= 20, 5).otherwise(6)


def merge_terms(terms: Column) -> Column:
    """Terms that are part of no other term, longest first, then in their order."""
    kept = F.filter(F.array_distinct(terms), lambda x: ~F.exists(terms, lambda y: (y != x) & F.contains(y, x)))
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.transform(ranked, lambda s: s["x"])


def simplify(c: Column, stop_characters: str) -> Column:
    """The query without its edge phrases, the given characters and punctuation; its Latin words if too little is left."""
    out = F.regexp_replace(F.regexp_replace(c, rf"^({SIMPLE_LEADING})\s*", ""), rf"({SIMPLE_ENDINGS})\s*[？?]?$", "")
    out = F.regexp_replace(F.regexp_replace(out, f"[{stop_characters}]", " "), SIMPLE_PUNCTUATION, " ")
    out = trim_all(F.regexp_replace(out, r"\s+", " "))
    words = F.array_join(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9_-]+"), F.lit(0)), " ")
    return F.when((F.length(out) < 3) & (words != ""), words).otherwise(out)


def expand_keywords(c: Column) -> Column:
    """Up to four search phrases from the technical terms and the intents that the query names."""
    found = F.regexp_extract_all(c, F.lit("[a-zA-Z][a-zA-Z0-9_-]*"), F.lit(0))
    terms = F.filter(F.transform(found, F.lower), lambda t: ~t.isin(QUESTION_VERBS))
    every, first = F.array_join(terms, " "), F.get(terms, 0)
    says = lambda *ws: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in ws])
    intents = [(says(*named), several, single) for named, several, single in INTENTS]
    phrases = lambda base, k: [F.when(i[0], F.array(*[F.concat(base, F.lit(" " + w)) for w in i[k]])).otherwise(F.array().cast("array<string>")) for i in intents]
    many = F.array_distinct(F.concat(*phrases(every, 1), F.array(every)))
    one = F.array_distinct(F.concat(*phrases(first, 2)))
    return F.when(F.size(terms) == 0, F.array().cast("array<string>")).when(F.size(terms) >= 2, F.slice(many, 1, 4)).otherwise(F.slice(one, 1, 4))


def variants(c: Column, stop_characters: str) -> Column:
    """Distinct forms of a query in the order original, rewritten, entities, simplified, expansions; capped by length."""
    entities = F.array_join(merge_terms(tokenize(c)), " ")
    own = F.concat(F.array(c, rewrite(c), F.when(entities == "", c).otherwise(entities), simplify(c, stop_characters)), expand_keywords(c))
    return F.slice(F.array_distinct(F.filter(own, lambda x: x != "")), F.lit(1), variant_cap(c))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def mime_of(name: Column) -> Column:
    suffix = F.lower(F.substring_index(name, ".", -1))
    return F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in MIME.items()], F.lit("application/octet-stream"))
