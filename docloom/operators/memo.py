"""A memory of embeddings that lasts from run to run: what was embedded once is looked up.

A folder holds ``entries`` (two 64-bit hashes of the text, the text, its embedding) and ``uses`` (the hashes that a run asked
for and the memory had), both partitioned by run, a number that grows from run to run. A run takes the distinct texts it is
asked for; those that the entries of earlier runs hold, compared by the text itself behind the hashes, are hits, the
others are embedded and written under the run's number. A run that is repeated under its number replaces what it wrote and
gives the same result. ``kept`` copies the memory without entries that were not used for long, or beyond a number of them.

Defined results: blank texts have no embedding and are left out, as by ``embedding.embed_texts``; repeated rows come back each.
Nothing is collected; texts meet by their hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import store
from docloom.operators.embedding import embedded
from docloom.storage import table_exists

ENTRIES = "h1 long, h2 long, text string, embedding array<float>, run long"
USES = "h1 long, h2 long, run long"
KEY = ["h1", "h2"]


@dataclass
class Memo:
    path: str

    def entries(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._table(spark, "entries", ENTRIES, before)

    def uses(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._table(spark, "uses", USES, before)

    def _table(self, spark: SparkSession, name: str, schema: str, before: int | None) -> DataFrame:
        path = f"{self.path}/{name}"
        rows = spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)
        return rows if before is None else rows.filter(F.col("run") < before)

    def embed(self, df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], run: int) -> DataFrame:
        """``df`` without blank texts, with ``embedding``. A run's number is above those of the runs it may know from."""
        spark = df.sparkSession

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return embedded(batches, "text", embedder)

        hashed = df.filter(F.regexp_replace(text, r"[\x00-\x20]", "") != "").withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
        asked = hashed.select("h1", "h2", F.col(text).alias("text")).distinct()
        known = self.entries(spark, run)
        misses = asked.join(known.select("h1", "h2", "text"), [*KEY, "text"], "left_anti")
        new = misses.mapInArrow(made, ENTRIES.removesuffix(", run long"))
        self._write(new, "entries", run)
        self._write(asked.join(known.select("h1", "h2", "text"), [*KEY, "text"], "left_semi").select(*KEY).distinct(), "uses", run)
        # An earlier run may hold a text twice if two of them ran side by side.
        have = self.entries(spark, run + 1).join(asked, [*KEY, "text"], "left_semi").groupBy(*KEY, "text").agg(F.min_by("embedding", "run").alias("embedding"))
        return hashed.join(have.withColumnRenamed("text", "_text"), KEY).filter(F.col(text) == F.col("_text")).drop(*KEY, "_text")

    def _write(self, rows: DataFrame, name: str, run: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def counts(self, spark: SparkSession) -> DataFrame:
        """(run, hits, misses) in distinct texts."""
        asked = self.uses(spark).select("run", F.lit(1).alias("hit")).unionByName(self.entries(spark).select("run", F.lit(0).alias("hit")))
        return asked.groupBy("run").agg(F.sum("hit").cast("long").alias("hits"), F.sum(1 - F.col("hit")).cast("long").alias("misses"))

    def kept(self, spark: SparkSession, path: str, since: int = 0, most: int | None = None) -> Memo:
        """A copy in ``path`` with the entries that were made or used in run ``since`` or later, and of those the ``most`` last
        used ones. Entries keep their run, and count as used in it."""
        entries = self.entries(spark)
        last = self.uses(spark).groupBy(*KEY).agg(F.max("run").alias("used"))
        rows = entries.join(last, KEY, "left").withColumn("used", F.greatest("run", F.coalesce("used", F.col("run")))).filter(F.col("used") >= since)
        if most is not None:
            rows = store.numbered(rows, [F.desc("used"), F.desc("run"), "h1", "h2"], "place").filter(F.col("place") < most).drop("place")
        rows.drop("used").write.mode("overwrite").partitionBy("run").parquet(f"{path}/entries")
        left = spark.read.schema(ENTRIES).parquet(f"{path}/entries").select(*KEY).distinct()
        self.uses(spark).filter(F.col("run") >= since).join(left, KEY, "left_semi").write.mode("overwrite").partitionBy("run").parquet(f"{path}/uses")
        return Memo(path)
