"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def surrogate_key(
    members: DataFrame, natural: str, key: str, assigned: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Dense integer keys for natural keys: ``natural, key``, those already ``assigned`` unchanged.

    New members are numbered within buckets of their hash, and each bucket starts where the ones before it
    end.  The numbering depends on nothing but the members, so a repeated or retried run gives the same keys,
    and no task sees more than one bucket; only the ``buckets`` bucket sizes meet in one place.
    """
    fresh = members.select(natural).filter(F.col(natural).isNotNull()).distinct()
    start = F.lit(0)
    if assigned is not None:
        fresh = fresh.join(assigned.select(natural), natural, "left_anti")
        start = F.coalesce(assigned.agg(F.max(key)).scalar(), F.lit(0))
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(natural), F.lit(buckets)))
    sizes = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(natural))
    numbered = fresh.withColumn("place", place).join(F.broadcast(starts), "bucket")
    new_keys = numbered.select(natural, (start + F.col("before") + F.col("place")).cast("bigint").alias(key))
    return new_keys if assigned is None else assigned.select(natural, key).unionByName(new_keys)


def fact_key(*natural: str | Column) -> Column:
    """Key of a fact row: a hash of its natural key, so that no numbering over the whole fact is needed."""
    return F.xxhash64(*natural)
