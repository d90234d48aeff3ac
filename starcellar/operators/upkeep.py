"""Keeping stored tables current: change detection, type-1 upsert, and versions of dimension rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED, MISSING = "new", "changed", "unchanged", "missing"
INVENTORY_COLUMNS = ("CurrentStock", "LastCostPrice", "ReorderLevel", "TargetStockLevel")


def _both(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored and incoming rows side by side.  Keys are unique on both sides, so no partition is skewed."""
    old = stored.select(key, F.struct(*columns).alias("old"))
    new = incoming.select(key, F.struct(*columns).alias("new"))
    return old.join(new, key, "full_outer")


def _change(columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for column in columns:
        same = same & F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))
    return (
        F.when(F.col("old").isNull(), NEW).when(F.col("new").isNull(), MISSING)
        .when(same, UNCHANGED).otherwise(CHANGED)
    )


def change_set(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each key with what an upsert does to it: new, changed, unchanged, or missing from the incoming rows."""
    return _both(stored, incoming, key, columns).select(key, _change(columns).alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table after a type-1 upsert: new rows added, changed ones replaced, missing ones kept.

    One full outer join instead of an update per row.  Write the result as a new version.
    """
    latest = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("row")
    return _both(stored, incoming, key, columns).select(key, latest).select(key, "row.*")


def upsert_inventory(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, "ProductKey", INVENTORY_COLUMNS)


def first_history(members: DataFrame, since: dt.date) -> DataFrame:
    """All rows as current versions."""
    return members.withColumns(
        {"validFrom": F.lit(since), "validTo": F.lit(None).cast("date"), "isCurrent": F.lit(True)}
    )


def current_rows(history: DataFrame) -> DataFrame:
    """The versions that are valid now."""
    return history.filter("isCurrent")


def dim_history(history: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], day: dt.date) -> DataFrame:
    """The history after a load: a changed row closes its version and opens one; a missing row stays current.

    Closed versions are passed through without a join.  A row loaded unchanged on any day changes nothing, so
    loading the same rows twice equals loading them once.
    """
    shape = [key, *columns, "validFrom", "validTo", "isCurrent"]
    closed = history.filter(~F.col("isCurrent")).select(*shape)
    current = history.filter("isCurrent")
    old = current.select(key, F.struct(*columns).alias("old"), "validFrom")
    new = incoming.select(key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full_outer").withColumn("change", _change(columns))
    since, opened = F.lit(day), F.struct(
        F.col("new").alias("row"), F.lit(day).alias("validFrom"), F.lit(None).cast("date").alias("validTo"),
        F.lit(True).alias("isCurrent"),
    )

    def kept(until: Column, is_current: bool) -> Column:
        return F.struct(
            F.col("old").alias("row"), F.col("validFrom"), until.alias("validTo"), F.lit(is_current).alias("isCurrent")
        )

    versions = (
        F.when(F.col("change") == NEW, F.array(opened))
        .when(F.col("change") == CHANGED, F.array(kept(since, False), opened))
        .otherwise(F.array(kept(F.lit(None).cast("date"), True)))
    )
    rows = both.select(key, F.explode(versions).alias("v"))
    return closed.unionByName(rows.select(key, "v.row.*", "v.validFrom", "v.validTo", "v.isCurrent"))
