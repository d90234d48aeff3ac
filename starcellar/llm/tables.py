"""Reading the corpus, storing what later steps share, and walking over texts inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.session import scratch_path

PORTION = 2 << 20  # bytes of rows that Python functions work on at a time
STEP = 65536  # rows that one row unfolds to in a task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there and any executor can read it."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unfolded(rows: DataFrame, count: str, number: str, step: int = STEP) -> DataFrame:
    """Each row ``count`` times, numbered from 0 by ``number``; ``count`` goes.

    A row that unfolds to more than ``step`` rows is first cut into parts, which are dealt to all tasks, so that no
    task makes all copies of a hot row.
    """
    others = [c for c in rows.columns if c != count]
    size, begin = F.col(count).cast("long"), F.col("_begin")

    def numbered(part: DataFrame, first: Column, last: Column) -> DataFrame:
        return part.select(*others, F.explode(F.sequence(first, last)).alias(number))

    few = numbered(rows.where((size > 0) & (size <= step)), F.lit(0).cast("long"), size - 1)
    many = rows.where(size > step).withColumn("_begin", F.explode(F.sequence(
        F.lit(0).cast("long"), size - 1, F.lit(step).cast("long"))))
    many = many.repartition(*(F.col(c) for c in (*others, "_begin")))
    return few.unionByName(numbered(many, begin, F.least(begin + step, size) - 1))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; an unknown id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def binaries(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a missing text is an empty one."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def portions(batches: Iterator[pa.RecordBatch], size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows of about ``size`` bytes, so that a task holds few texts at once in Python."""
    for batch in batches:
        rows = max(1, size * batch.num_rows // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
        pa.default_memory_pool().release_unused()


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``limit`` together; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
