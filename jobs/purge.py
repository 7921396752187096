"""Purge a store of documents and vectors, and renumber what is left.

    python -m jobs.purge --documents D --labels L --embeddings V --out OUT --config jobs/purge.json

What goes: documents of the sources that the config names, documents with a label that it names (1 in that column of the
labels), their vectors, vectors whose document is gone, and vectors that are null. What stays is written to OUT:
``chunks`` partitioned by source, ``vectors`` with dense node numbers in the order of ids, partitioned by shard, and
``report``, a row per source with what was read, kept and purged for which reason. Each output replaces what lay there:
a source that is purged must not leave its old partition, so partitions aren't overwritten one by one. A run over the same
tables gives the same rows, and one that was stopped is healed by the next.

Labels of unknown documents and labels that are null purge nothing; a document that is labelled twice goes if one says so. A
document with a null id has no label and no vector, and goes only with its source. An empty source is read back as null.
"""

from __future__ import annotations

import logging
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.operators import store

log = logging.getLogger("purge")
OUTPUTS = {
    "chunks": "id long, content string, source string",
    "vectors": "doc_id long, embedding array<float>, node_id long, shard int",
    "report": "n_read long, n_kept long, n_by_source long, n_by_label long, n_vectors long, source string",
}


def doomed(documents: DataFrame, labels: DataFrame, sources: list[str], label_columns: list[str]) -> DataFrame:
    """``documents`` with the reason why each goes: ``source``, ``label`` or null."""
    named = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 1, F.lit(False)) for c in label_columns], F.lit(False))
    marked = labels.filter(named).select("doc_id").distinct().withColumn("_marked", F.lit(True))
    by_source = F.coalesce(F.col("source").isin(sources), F.lit(False)) if sources else F.lit(False)
    return documents.join(marked, "doc_id", "left").withColumn("reason", F.when(by_source, "source").when(F.col("_marked"), "label")).drop("_marked")


def purged(documents: DataFrame, labels: DataFrame, embeddings: DataFrame, sources: list[str], label_columns: list[str], shards: int) -> dict[str, DataFrame]:
    """The three outputs."""
    judged = doomed(documents.select("doc_id", "text", F.nullif("source", F.lit("")).alias("source")), labels, sources, label_columns)
    gone = judged.filter("reason is not null and doc_id is not null").select("doc_id").distinct()
    chunks = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.nullif("source", F.lit("")).alias("filename"))
    left, kept = store.compact_tables(store.delete_files(chunks, sources), embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), gone)
    left = left.withColumnRenamed("filename", "source")
    vectors = kept.withColumn("shard", F.pmod("node_id", F.lit(shards)).cast("int"))
    own = kept.select("doc_id").withColumn("_n", F.lit(1)).groupBy("doc_id").agg(F.sum("_n").alias("_n"))
    # The vectors of a document count once, however many rows the document has.
    held = left.select(F.col("id").alias("doc_id"), "source").groupBy("doc_id").agg(F.min("source").alias("source")).join(own, "doc_id").groupBy("source").agg(F.sum("_n").alias("n_vectors"))
    is_gone = gone.withColumn("_gone", F.lit(True))
    counts = judged.join(is_gone, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("_gone").isNull() & F.coalesce(F.col("reason") != "source", F.lit(True))).alias("n_kept"), F.count_if(F.col("reason") == "source").alias("n_by_source"),
        F.count_if(F.col("_gone") & F.coalesce(F.col("reason") != "source", F.lit(True))).alias("n_by_label"),
    )
    report = counts.join(held, counts["source"].eqNullSafe(held["source"]), "left").select("n_read", "n_kept", "n_by_source", "n_by_label", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), counts["source"])
    return {"chunks": left, "vectors": vectors, "report": report}


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(OUTPUTS[name]).parquet(f"{out}/{name}")


def run(spark: SparkSession, documents: str, labels: str, embeddings: str, out: str, sources: list[str], label_columns: list[str], shards: int = 16) -> dict[str, int]:
    """Write the three outputs and return how many rows each has."""
    read = {name: spark.read.parquet(path) for name, path in (("documents", documents), ("labels", labels), ("embeddings", embeddings))}
    made = purged(**read, sources=sources, label_columns=label_columns, shards=shards)
    for name, by in (("chunks", "source"), ("vectors", "shard"), ("report", None)):
        columns = [c.split()[0] for c in OUTPUTS[name].split(", ")]
        writer = made[name].select(columns).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{out}/{name}")
    written = {name: read_output(spark, out, name).count() for name in OUTPUTS}
    totals = read_output(spark, out, "report").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_read", "n_by_source", "n_by_label")]).first().asDict()
    log.info("read %s documents of %s; purged %s by source, %s by label", totals["n_read"], documents, totals["n_by_source"], totals["n_by_label"])
    for name, n in written.items():
        log.info("wrote %s rows to %s/%s", n, out, name)
    return written


if __name__ == "__main__":
    from jobs.common import main

    main(run, __doc__, ["documents", "labels", "embeddings", "out"])
