"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text. Each works on whole texts and
on all rows that the one before kept. Other columns, whatever their names, are dropped by the first stage. Rows with a null
doc_id are documents of their own; rows that share a doc_id are one document. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language, line_dedup, near_dup, packing, secrets
from docloom.llm.queries import BYTE_BPE_IDS, BYTE_BPE_RANKS, public_tokenizers
from docloom.storage import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose cosine with their language is lower are rejected, as are those without a letter.
LEAST_SCORE = 0.05


def as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach. A null or empty text, or one without a letter, has none and
    goes; a null ``lang`` teaches nothing. Repeated rows have one fate. Very long texts are counted in slices."""
    found = language.identify(docs, language.learn(docs.select("text", "lang")))
    return found.filter((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in the one with the largest doc_id, in all rows of it. A null text
    becomes an empty one. A very long text is held, with its lines, in the task that reads it."""
    return as_documents(line_dedup.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; all its rows stay, as one document. A
    text without words, and a row with a null doc_id, is like no other and stays. Very long texts are hashed in slices."""
    gone = near_dup.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by the secret's kind; every row stays. A null text becomes an empty one; a very
    long one is scanned whole."""
    return as_documents(secrets.scan_secrets(docs, BYTE_BPE_RANKS, public_tokenizers.PATTERN, redact=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence. Each row is packed by itself, repeated ones too; a null or empty text is one
    piece with the end token alone. A very long text is cut into pieces of a sequence's length."""
    return packing.pack(docs.select("doc_id", "text"), BYTE_BPE_IDS)


STAGES = [("language_id", language_id), ("dedup_lines", dedup_lines), ("near_duplicates", dedup_documents), ("secret_scan", scan_secrets), ("pack_sequences", pack)]
#: SQL can't express the language model, the tokenizers or the packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
