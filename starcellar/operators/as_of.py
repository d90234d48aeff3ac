"""Point-in-time lookup: the version of a member that was valid on the day of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of_lookup(
    rows: DataFrame, versions: DataFrame, key: str, day: str, since: str, take: Sequence[str]
) -> DataFrame:
    """The rows with the columns ``take`` of the version of their ``key`` that began last, on their ``day`` or before.

    ``versions`` has one row per ``key`` and day ``since`` it is valid; rows before the first version of their key, of
    unknown keys, or without key or day keep NULLs.

    Only equal keys are joined.  The versions of a key are one row, in the order they began, so the rows are shuffled by
    their key once, or not at all where they are dealt by it already; Spark splits a frequent key among several tasks.
    """
    began = versions.select(F.col(key).alias("_key"), F.struct(F.col(since).alias("since"), F.struct(*take).alias("of")).alias("_one"))
    lines = began.groupBy("_key").agg(F.sort_array(F.collect_list("_one")).alias("_line"))
    found = rows.join(lines, F.col(key) == F.col("_key"), "left")
    on = F.col(day)
    valid = F.filter("_line", lambda one: on.isNotNull() & (one["since"].isNull() | (one["since"] <= on)))
    found = found.withColumn("_version", F.try_element_at(valid, F.lit(-1))["of"])
    kept = [F.col(c) for c in rows.columns if c not in take]
    return found.select(*kept, *(F.col(f"_version.{c}").alias(c) for c in take))
