"""Writers: append, reload, versioned replacement, and the load log."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from starcellar.schemas import WAREHOUSE


def append_sink(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a stored table, one set of files per task."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def reload_sink(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), only_partitions: bool = False) -> None:
    """Replace a stored table, or with ``only_partitions`` just the partitions present in ``df``."""
    mode = "dynamic" if only_partitions else "static"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The pointer rows of a versioned table, or None before the first version."""
    try:
        return spark.read.schema("version STRING").json(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the version the pointer names, the one with the highest number."""
    pointer = _latest(spark, root)
    return pointer.agg(F.max("version")).first()[0] if pointer is not None else None


def read_versioned(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version written below {root}")
    return spark.read.parquet(f"{root}/{version}")


def next_version(spark: SparkSession, root: str) -> str:
    """A name that stands after the current version's, whatever the clocks say."""
    current = current_version(spark, root)
    number = int(current.split("-")[1]) + 1 if current else 1
    return f"v-{number:012d}-{uuid.uuid4().hex}"


def switch_version(spark: SparkSession, root: str, version: str) -> None:
    """Make a version that is written in full the one that readers see."""
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{root}/pointer")


def write_versioned(df: DataFrame, root: str) -> str:
    """Write a whole new version beside the old one, then switch the pointer.

    Readers see the old version until the new one is complete, and a job that dies half-way leaves a
    folder nobody points to.  This is what makes it safe to write a table derived from itself.
    """
    version = next_version(df.sparkSession, root)
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    switch_version(df.sparkSession, root, version)
    return version


class WatermarkStore:
    """Last loaded date per table, kept as a small versioned table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self) -> DataFrame:
        if current_version(self.spark, self.root) is None:
            return self.spark.createDataFrame([], WAREHOUSE["LoadLog"])
        return read_versioned(self.spark, self.root)

    def read(self, table: str) -> dt.date | None:
        row = self.table().filter(F.col("TableName") == table).first()
        return row["LastLoadDate"] if row else None

    def advance(self, table: str, written_dates: DataFrame) -> dt.date | None:
        """Move the mark to the latest of the dates just written; a run without rows leaves it alone.

        ``written_dates`` has one date column.  Taking it from the written rows, not from the source,
        means that source rows which arrived during the load are still picked up next time.
        """
        date = written_dates.columns[0]
        mark = written_dates.agg(F.max(date).alias("LastLoadDate")).first()["LastLoadDate"]
        if mark is None:
            return self.read(table)
        kept = self.table().filter(F.col("TableName") != table)
        moved = self.spark.createDataFrame([(table, mark)], WAREHOUSE["LoadLog"])
        write_versioned(kept.unionByName(moved), self.root)
        return mark
