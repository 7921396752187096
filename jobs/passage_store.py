"""Keep a store of passages up to date with a growing table of documents.

    python -m jobs.passage_store --documents IN --out OUT --checkpoint MARKS --config jobs/passage_store.json

Each run takes the Parquet files that have come to the table since the run before, cuts their documents into passages of
a few sentences that overlap, and adds them to OUT, partitioned by status and source. What is new is known from the
checkpoint alone: its log of files, and its state of the document ids that the store has, so a document that comes again
in a later file is skipped, as an upload under a known name is. Spark's file sink makes a batch's files visible at once,
so a run that is stopped and started again gives the same rows, and a run without new files adds none.

Every document has at least one row. Without passages it has one with nulls, whose status says why: ``empty``, ``blank``
or ``too_large``; ``large`` is a warning. Of rows with one doc_id in one batch, one is taken; rows without doc_id are
counted in the log and skipped. The store reads an empty source as null, as Spark's partitions do. Files that are
rewritten in place aren't read again.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.functions import text
from docloom.operators import chunking
from docloom.sources import files

log = logging.getLogger("passage_store")
DOCUMENTS = "doc_id long, text string, source string"
STORE = "doc_id long, file_size long, chunk_index int, total_chunks int, content string, tokens long, status string, source string"


def as_pattern(path: str) -> str:
    """A pattern that only ``path`` matches: a stream takes a path without one for a folder, and a table may be a file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def windows(parts: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` of the ``parts``, each but the first beginning with the last ``overlap`` of the one before."""
    step = size - overlap
    n = F.when(F.size(parts) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((F.size(parts) - overlap) / step))).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i * step + 1, F.lit(size)), " "))


def passages(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """The store's rows of ``docs`` (doc_id, text, source)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    sized = files.validated(docs.withColumn("file_size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")))
    fits = F.col("status").isin("ok", "large")
    blank = fits & (text.trim_all(F.col("text")) == "")
    whole = sized.withColumn("status", F.when(blank, "blank").otherwise(F.col("status")))
    parts = chunking.sentences(F.when(F.col("status").isin("ok", "large"), F.col("text")).otherwise(F.lit("")))
    cut = whole.withColumn("parts", parts).withColumn("passages", windows(F.col("parts"), size, overlap))
    rows = cut.select("doc_id", "file_size", "status", "source", F.size("passages").alias("total_chunks"), F.posexplode_outer("passages").alias("chunk_index", "content"))
    return rows.select("doc_id", "file_size", "chunk_index", "total_chunks", "content", F.when(F.col("content").isNotNull(), text.token_estimate_a(F.col("content"))).alias("tokens"), "status", "source")


def read_store(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(out)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, size: int = 5, overlap: int = 1, files_per_batch: int = 1000) -> list[dict]:
    """Take what is new and return what was read and written, batch by batch."""
    rows = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(documents))
    rows = rows.observe("read", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"))
    fresh = rows.filter("doc_id is not null").dropDuplicates(["doc_id"])
    made = passages(fresh, size, overlap).observe("written", F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("chunk_index", F.lit(0)) == 0).alias("documents"))
    query = made.writeStream.format("parquet").partitionBy("status", "source").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = []
    for progress in query.recentProgress:
        seen = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        if seen.get("read", {}).get("rows"):
            batches.append({"batch": progress.batchId, **seen})
            log.info("batch %s: read %s from %s, wrote %s to %s", progress.batchId, seen["read"], documents, seen.get("written"), out)
    if not batches:
        log.info("nothing new in %s", documents)
    return batches


if __name__ == "__main__":
    from jobs.common import main

    # The ids that the store has are kept on the executors' disks, not in memory.
    main(run, __doc__, ["documents", "out", "checkpoint"], {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
