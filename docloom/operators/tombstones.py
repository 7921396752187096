"""Deletes without rewriting: bitmaps of deleted row positions per file, read as a filter, emptied by compaction.

A delete reads the positions (file and row number in it) of the rows that a condition picks, and writes a bitmap of 4 KB,
which compresses to what is set in it, for each run of 32,768 rows of a file that has any. A read joins the bitmaps, the
union of all deletes, to the rows' places and leaves out those whose bit is set; files and runs without a bitmap pass.
Compaction writes what is left to a new folder, which has no bitmaps.

Defined results: a row that is deleted twice is deleted once; repeated rows go only where the condition picks them; a null
condition picks nothing. An empty table, and one without deletes, reads as it is. The table's files must not be changed
by others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import table_exists

BITMAPS = "file string, run long, bits binary"
#: Rows of a run, as Spark's bitmap functions deal them.
RUN = 8 * 4096


@dataclass
class Tombstones:
    """``table``: a Parquet table; ``path``: the folder of its bitmaps."""

    table: str
    path: str

    def placed(self, spark: SparkSession) -> DataFrame:
        """The table with the place of each row: ``_file``, ``_run`` and ``_bit``."""
        row = F.col("_metadata.row_index")
        return spark.read.parquet(self.table).select("*", F.col("_metadata.file_path").alias("_file"), F.floor(row / RUN).alias("_run"), (row % RUN).alias("_bit"))

    def bitmaps(self, spark: SparkSession) -> DataFrame:
        """(file, run, bits): the union of all deletes."""
        if not table_exists(spark, self.path):
            return spark.createDataFrame([], BITMAPS)
        return spark.read.schema(BITMAPS).parquet(self.path).groupBy("file", "run").agg(F.bitmap_or_agg("bits").alias("bits"))

    def live(self, spark: SparkSession) -> DataFrame:
        """The places and columns of rows that no delete has picked."""
        marks = self.bitmaps(spark).select(F.col("file").alias("_file"), F.col("run").alias("_run"), F.col("bits").alias("_bits"))
        byte = F.expr("conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10)").cast("long")
        gone = F.col("_bits").isNotNull() & (F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1)
        return self.placed(spark).join(marks, ["_file", "_run"], "left").withColumn("_byte", byte).filter(~gone).drop("_byte", "_bits")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.live(spark).drop("_file", "_run", "_bit")

    def delete(self, spark: SparkSession, condition: Column | None = None, keys: DataFrame | None = None) -> str:
        """Mark the rows that ``condition`` picks, or that ``keys`` has by the columns it shares with the table."""
        rows = self.live(spark)
        if condition is not None:
            rows = rows.filter(condition)
        if keys is not None:
            rows = rows.join(keys, keys.columns, "left_semi")
        # Bits are set as Spark's functions number them: position p is bit p % 8 of byte p div 8.
        made = rows.groupBy(F.col("_file").alias("file"), F.col("_run").alias("run")).agg(F.bitmap_construct_agg("_bit").alias("bits"))
        part = f"{self.path}/part={uuid.uuid4().hex}"
        made.write.parquet(part)
        return part

    def compact(self, spark: SparkSession, table: str, path: str) -> Tombstones:
        """What is left, in a new folder and without bitmaps."""
        self.read(spark).write.mode("overwrite").parquet(table)
        return Tombstones(table, path)
