"""Chunk and vector tables: append, delete, compact, inspect. Each returns new tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.storage import cut, table_exists


def delete_files(chunks: DataFrame, filenames: list[str]) -> DataFrame:
    return chunks.filter(~F.col("filename").isin(filenames) | F.col("filename").isNull())


def delete_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks without those whose id is in ``ids`` (id)."""
    return chunks.join(ids.select("id"), "id", "left_anti")


def cascade(vectors: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """Vectors without those of deleted chunks (doc_id)."""
    return vectors.join(deleted_ids, "doc_id", "left_anti")


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct doc_ids of vectors whose chunk is gone."""
    return vectors.select("doc_id").join(chunks.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").distinct()


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """``rows`` with the dense number ``name`` from ``first`` on, in the given order.

    Rows are dealt by ranges of about equal size and numbered within; only the sizes of ranges are summed in one task.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own") + (first - 1)).drop("_range", "_own", "_start")


def compact(vectors: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """Survivors with dense numbers from 0 in id order."""
    return numbered(cascade(vectors, deleted_ids).select("doc_id"), ["doc_id"], "node_id")


def compact_tables(chunks: DataFrame, vectors: DataFrame, deleted_ids: DataFrame, with_orphans: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables without deleted chunks and, if asked for, without vectors whose chunk is gone or null vectors; the
    vectors renumbered. What a scheduled job writes in place of the tables before it empties the tombstones."""
    left = chunks.join(deleted_ids.select(F.col("doc_id").alias("id")), "id", "left_anti")
    kept = cascade(vectors, deleted_ids)
    if with_orphans:
        kept = kept.filter("embedding is not null").join(left.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return left, numbered(kept, ["doc_id"], "node_id")


def deleted_stats(vectors: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    total = vectors.agg(F.count(F.lit(1)).alias("total_vector_count"))
    gone = deleted_ids.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("deleted_doc_ids_count"))
    ratio = F.when(F.col("total_vector_count") > 0, F.round(F.col("deleted_doc_ids_count") / F.col("total_vector_count"), 6)).otherwise(0.0)
    return gone.join(F.broadcast(total)).withColumn("deletion_ratio", ratio)


def files_by_recency(chunks: DataFrame) -> DataFrame:
    latest = chunks.groupBy("filename").agg(F.max("upload_time").alias("latest"))
    return numbered(latest, [F.desc("latest"), "filename"], "rank", 1).select("filename", F.col("rank").cast("int").alias("rank"))


def with_ids(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """Rows with ids from ``first`` on, in a given order."""
    return numbered(rows, order, "id", first)


def next_id(rows: DataFrame | None, name: str = "id") -> int:
    """The id after the highest one of ``rows``."""
    top = rows.agg(F.max(name)).first()[0] if rows is not None else None
    return 0 if top is None else top + 1


def with_vectors(rows: DataFrame) -> DataFrame:
    """Rows that have a vector, as only those are written."""
    return rows.filter("embedding is not null")


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """One batch in a folder of its own: written again, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows of the batches before one; None where there is no table yet."""
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("batch") < batch_id).drop("batch")


def insert(rows: DataFrame, out: str, batch_id: int, order: list[str]) -> None:
    """Insert ``rows``, which have an ``embedding`` or null, as one batch into ``chunks`` and ``vectors`` in the folder ``out``.

    Ids go on from the highest of the batches before it, in the given order; rows without an embedding are chunks only. A
    batch that runs again gets the same ids and replaces itself.
    """
    first = next_id(earlier(rows.sparkSession, f"{out}/chunks", batch_id))
    made = cut(with_ids(rows, order, first), "inserted")
    append(made.drop("embedding"), f"{out}/chunks", batch_id)
    append(with_vectors(made.select(F.col("id").alias("doc_id"), "embedding")), f"{out}/vectors", batch_id)


def insert_new(vectors: DataFrame, path: str, batch_id: int) -> None:
    """Insert those of ``vectors`` (doc_id, embedding) that no batch before it holds. Null ids and null vectors are left out;
    of several vectors with one id the least is taken."""
    fresh = with_vectors(vectors).filter("doc_id is not null").groupBy("doc_id").agg(F.min("embedding").alias("embedding"))
    before = earlier(vectors.sparkSession, path, batch_id)
    append(fresh if before is None else fresh.join(before.select("doc_id"), "doc_id", "left_anti"), path, batch_id)
