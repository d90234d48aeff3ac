"""Sales load as two streams, invoices and their lines, over the files of two tables.

The checkpoint takes the place of the load log: a file is loaded once, whenever it arrives.  Time is the arrival of a
file, as documents may bear any date.  Invoices wait in state for their lines and lines for their invoice, both for as
long as the watermark allows, so a batch reads what is new and no table over again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from starcellar.session import CODEC, RUN_SETTINGS, settings

BATCH = "load_batch"
# State of millions of rows is kept on disk, not in the executors' heap.  A checkpoint keeps the store it began with.
STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_SETTINGS = {STORE: ON_DISK, "spark.sql.streaming.stateStore.rocksdb.compression": "zstd", **RUN_SETTINGS}
TOLD = ("_told", "_told_again")


@dataclass(frozen=True)
class Side:
    """A table of files: its path (a folder at any depth, or one file), schema, key, and the columns that tell its rows apart."""

    path: str
    schema: StructType
    key: str
    unique: tuple[str, ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def stream(self, spark: SparkSession, arrived: str, wait: str, files_per_batch: int | None) -> DataFrame:
        reader = spark.readStream.schema(self.schema).option("recursiveFileLookup", True)
        reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
        rows = reader.parquet(self.path).select("*", F.col("_metadata.file_modification_time").alias(arrived))
        return self.told_apart(rows.withWatermark(arrived, wait))

    def told_apart(self, rows: DataFrame) -> DataFrame:
        """Rows known already left out; of rows told apart by many columns the state keeps 128 bits, not all their columns."""
        if len(self.unique) <= len(TOLD):
            return rows.dropDuplicatesWithinWatermark(list(self.unique))
        # A hash passes over nulls, so where they stand is hashed too.
        given = [x for c in self.unique for x in (F.col(c).isNull(), F.col(c))]
        hashed = rows.withColumns(dict(zip(TOLD, (F.xxhash64(*given), F.xxhash64(F.lit(1), *given[::-1])), strict=True)))
        return hashed.dropDuplicatesWithinWatermark(list(TOLD)).drop(*TOLD)


@dataclass(frozen=True)
class SalesStream:
    """``to_fact`` turns lines that carry their invoice's columns into fact rows and keeps the line's ``identity``.

    ``wait`` is how long an invoice and its lines wait for each other, and how long a repeated row is known for one.
    Fact rows go to ``output``, lines whose invoice did not come in time to ``late``.
    """

    heads: Side
    lines: Side
    to_fact: Callable[[DataFrame], DataFrame]
    identity: tuple[str, ...]
    output: str
    late: str
    checkpoint: str
    wait: str = "7 days"

    def run(self, spark: SparkSession, files_per_batch: int | None = None) -> list[dict]:
        """Load every file not loaded yet, settle late lines, then stop; returns the progress of the batches.

        Both sides are freed of repeated rows and joined where they arrived at most ``wait`` apart, so state goes as
        the watermark moves on.  Each batch writes partitions of its own, and one repeated after a failure replaces
        them.  Lines still without invoice when they leave the state are kept apart.
        """
        heads = self.heads.stream(spark, "head_arrived", self.wait, files_per_batch)
        lines = self.lines.stream(spark, "line_arrived", self.wait, files_per_batch)
        near = F.expr(f"line_arrived >= head_arrived - INTERVAL {self.wait} AND line_arrived <= head_arrived + INTERVAL {self.wait}")
        joined = lines.join(heads, (lines[self.lines.key] == heads[self.heads.key]) & near, "left_outer")

        def write(rows: DataFrame, batch: int) -> None:
            rows = rows.drop("line_arrived", "head_arrived").persist()
            matched = F.col(self.heads.key).isNotNull()
            self._write(self.to_fact(rows.filter(matched)), str(batch), self.output)
            self._write(rows.filter(~matched).select(self.lines.schema.names), str(batch), self.late)
            rows.unpersist()

        writer = joined.writeStream.foreachBatch(write).option("checkpointLocation", self.checkpoint)
        with settings(spark, STREAM_SETTINGS):
            query = writer.trigger(availableNow=True).start()  # takes the session's settings as they are now
        query.awaitTermination()
        progress = list(query.recentProgress)
        if not progress:
            return progress
        name, kept = f"after-{progress[-1]['batchId']}", int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))
        if len(progress) >= kept or any(map(dropped, progress)):
            self.settle(spark, name, self.lines.rows(spark))
        elif (late := self._stored(spark, self.late)) is not None and late.limit(1).count():
            self.settle(spark, name, late)
        return progress

    def settle(self, spark: SparkSession, name: str, late: DataFrame) -> None:
        """Add late lines whose invoice has come since to the fact, as the partition ``name``.

        Lines that the fact has, by their identity, are not added again.  ``late`` are the lines kept apart; after a run
        that met files older than the watermark, whose rows the join leaves out, all lines, which are read once.
        """
        lines = late.select(self.lines.schema.names).dropDuplicates(list(self.lines.unique))
        heads = self.heads.rows(spark).dropDuplicates(list(self.heads.unique))
        found = self.to_fact(lines.join(heads, lines[self.lines.key] == heads[self.heads.key]))
        loaded = self._stored(spark, self.output)
        if loaded is not None:
            held = loaded.filter(F.col(BATCH) != name).select(*self.identity)
            found = found.join(held, list(self.identity), "left_anti").select(*found.columns)
        self._write(found, name, self.output)

    @staticmethod
    def _stored(spark: SparkSession, path: str) -> DataFrame | None:
        """What batches have written, or None if none held a row."""
        try:
            return spark.read.parquet(path).withColumn(BATCH, F.col(BATCH).cast("string"))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    @staticmethod
    def _write(rows: DataFrame, batch: str, path: str) -> None:
        rows = rows.withColumn(BATCH, F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(
            path, compression=CODEC)


def dropped(progress: dict) -> int:
    """Rows of a batch that came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])


def state_rows(progress: dict) -> int:
    """Rows that a batch left in state."""
    return sum(op["numRowsTotal"] for op in progress["stateOperators"])
