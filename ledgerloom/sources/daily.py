"""A table that takes batches once each, whole or not at all, and keeps the first row of every key.

A batch's new rows are written to a folder of its own, then its number is entered among the commits. Readers see committed folders
only. A batch that failed before its commit left nothing that is read, and is written over when it comes again; one that was committed
is skipped. Batches are written one after the other; of two writers of one batch the second to commit gets an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FirstWins:
    """The table in a folder that all executors share; schema: as DDL; keys: what names a row."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]

    def _commits(self) -> DataFrame:
        """One row for each committed batch."""
        self.spark.createDataFrame([], "number bigint").write.mode("ignore").parquet(f"{self.folder}/commits/batch=-1")
        return self.spark.read.schema("number bigint, batch bigint").parquet(f"{self.folder}/commits").where("number IS NOT NULL").select("number")

    def committed(self, batch: int) -> bool:
        return not self._commits().where(F.col("number") == batch).isEmpty()

    def read(self) -> DataFrame:
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.folder}/rows/batch=-1")
        rows = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(f"{self.folder}/rows")
        return rows.join(F.broadcast(self._commits()), F.col("batch") == F.col("number"), "left_semi").drop("batch")

    def write(self, incoming: DataFrame, batch: int, order: str) -> bool:
        """Adds the incoming rows whose key is new, of several with one key the first by order; False if the batch was there."""
        if self.committed(batch):
            return False
        stored = self.read()
        first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(order))).where("__n = 1")
        new = first.join(stored.select(*self.keys), list(self.keys), "left_anti").select(*stored.columns)
        new.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        self.spark.range(batch, batch + 1).select(F.col("id").alias("number")).coalesce(1).write.mode("error").parquet(f"{self.folder}/commits/batch={batch}")
        return True
