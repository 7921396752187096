"""Streaming ingest of a folder: each micro-batch writes chunks and vectors, then the mark that makes them visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, embedding, store
from docloom.operators.postings import GrowingIndex
from docloom.sources import files
from docloom.storage import table_exists


# How far a file is at each step, in per cent.
READING, PARSING, EMBEDDING, STORING, STORED, DONE = 10, 30, 60, 70, 80, 100
FILE = "path string, modificationTime timestamp, length long, content binary"


def chunk_rows(texts: DataFrame, embedder) -> DataFrame:
    """Chunks of (filename, file_size, mime_type, text), with embeddings."""
    docs = files.non_blank(texts).withColumn("id", F.xxhash64("filename")).dropDuplicates(["filename"])
    chunks = chunking.hierarchical_chunks(docs.select("id", F.col("text").alias("content")), embedder)
    rows = chunks.join(docs.select("id", "filename", "file_size", "mime_type"), "id").withColumn("id", F.xxhash64("filename", "chunk_index"))
    return embedding.embed_texts(rows, "content", embedder)


def ingest(spark: SparkSession, folder: str, out: str, embedder, files_per_batch: int = 100, index: GrowingIndex | None = None):
    """Process what lies in ``folder`` and return the finished query. A batch that runs again replaces itself, and a
    file name that an earlier batch stored is skipped."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return ingest_stream(spark, raw, out, embedder, index)


def read_once(raw: DataFrame) -> DataFrame:
    """(filename, file_size, mime_type, text, reason) of a stream of files; of those with a text, each name once ever.

    The names are the stream's state, kept by its checkpoint: no table is read to know them. A file that is refused
    leaves its name free.
    """
    sized = files.validated(files.described(raw))
    fits = F.col("status").isin("ok", "large")
    read = files.read_all(sized.withColumn("content", F.when(fits, F.col("content")).otherwise(F.lit(b""))))
    judged = files.validated(read).withColumn("reason", F.when(fits, F.col("reason")).otherwise(F.col("status"))).drop("status")
    return judged.withColumn("_key", F.when(F.col("reason").isNull(), F.col("filename")).otherwise(F.concat("filename", F.lit("/"), F.expr("uuid()")))).dropDuplicates(["_key"]).drop("_key")


def ingest_stream(spark: SparkSession, raw: DataFrame, out: str, embedder, index: GrowingIndex | None = None):
    """The same for any stream of (path, length, content).

    Tables written: ``chunks`` with dense ids from 0 on, ``vectors`` of those that have one, ``progress`` (a row per
    file and step: task_id, progress, status, reason, timestamp in ms) and ``commits``, whose marks make a batch visible
    and say which id comes next, so that a batch reads nothing of earlier ones but the last mark. An ``index`` takes a
    batch's chunks once they are visible; a batch that fails there runs again as a whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.persist()

        def mark(progress: int, status: str, rows: DataFrame) -> None:
            own = rows.select(F.col("filename").alias("task_id"), F.lit(progress).alias("progress"), F.lit(status).alias("status"), "reason", F.unix_millis(F.current_timestamp()).alias("timestamp"))
            store.append(own, f"{out}/progress/step={progress}-{status}", batch_id)

        try:
            first, kept = next_first(spark, out, batch_id), seen.filter("reason is null")
            mark(READING, "READING", seen)
            mark(DONE, "REJECTED", seen.filter("reason is not null"))
            mark(PARSING, "PARSING", kept)
            rows = store.with_ids(chunk_rows(kept.drop("reason"), embedder).drop("id"), ["filename", "chunk_index"], first)
            mark(EMBEDDING, "EMBEDDING", kept)
            store.append(rows.select("id", "filename", "content", "parent_content", "chunk_index", "total_chunks", "file_size", "mime_type"), f"{out}/chunks", batch_id)
            mark(STORING, "STORING", kept)
            store.append(store.with_vectors(rows.select(F.col("id").alias("doc_id"), "embedding")), f"{out}/vectors", batch_id)
            mark(STORED, "STORED", kept)
            n = spark.read.parquet(f"{out}/chunks/batch={batch_id}").count()
            store.append(spark.createDataFrame([(batch_id, first + n)], "batch_id long, next_id long"), f"{out}/commits", batch_id)
            if index is not None:
                index.add(spark.read.parquet(f"{out}/chunks/batch={batch_id}").select("id", "content"), batch_id)
            mark(DONE, "COMPLETED", kept)
        finally:
            seen.unpersist()

    query = read_once(raw).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def next_first(spark: SparkSession, out: str, batch_id: int) -> int:
    """The first id of a batch: what the one before left."""
    last = f"{out}/commits/batch={batch_id - 1}"
    if batch_id and table_exists(spark, last):
        return spark.read.parquet(last).first()["next_id"]
    marks = spark.read.parquet(f"{out}/commits").filter(F.col("batch_id") < batch_id) if table_exists(spark, f"{out}/commits") else None
    return store.next_id(marks, "next_id") - 1 if marks is not None and not marks.isEmpty() else 0


def committed(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A table's rows of committed batches; None before the first."""
    if not table_exists(spark, f"{out}/commits"):
        return None
    marks = spark.read.parquet(f"{out}/commits").select(F.col("batch_id").alias("batch"))
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").join(marks, "batch", "left_semi").drop("batch")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(task_id, progress, status, reason, timestamp) of all files, also of batches that did not end."""
    return spark.read.option("basePath", f"{out}/progress").parquet(f"{out}/progress").drop("step", "batch")
