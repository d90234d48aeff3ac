"""Lookup of keys in a reference table, the step between a source row and a fact row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROP, FAIL, KEEP = "drop", "fail", "keep"
LIST_ROWS = 10_000  # a list of names, such as delivery methods, has at most so many


def short_list(df: DataFrame, rows: int = LIST_ROWS) -> DataFrame:
    """A list of names that is sent to every task, so that the few keys of a fact's rows are never shuffled by.

    The list is fetched, which checks its size: a longer one is no list, and the load fails instead of broadcasting it.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a list of {', '.join(df.columns)} has more than {rows} rows")
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def lookup(
    df: DataFrame, reference: DataFrame, on: Mapping[str, str], take: Mapping[str, str], mode: str = DROP,
    first_by: str | None = None, unique: bool = False,
) -> DataFrame:
    """Add reference columns to each row by an equal key.

    ``on`` maps a column of ``df`` to the reference column it equals, ``take`` a reference column to its new
    name.  Where several reference rows share a key the first by ``first_by`` counts (by its values, if not
    given); ``unique`` says they do not.  Rows without a match are dropped, make the job fail, or keep NULLs.

    The reference is reduced to one row per key, so a lookup never multiplies rows.  Its shuffle by key is the
    one a sort-merge join needs; Spark broadcasts it only where its size is below the session's threshold, and
    AQE splits a key that fills a partition.
    """
    keys = list(on.values())
    if unique:
        rows = reference.select(*keys, F.struct(*take).alias("_found"))
    else:
        values = F.struct(*take)
        first = F.min(values) if first_by is None else F.min_by(values, F.col(first_by))
        rows = reference.groupBy(*keys).agg(first.alias("_found"))
    rows = rows.select(*(F.col(key).alias(f"_key_{i}") for i, key in enumerate(keys)), "_found")
    matches = [F.col(column) == F.col(f"_key_{i}") for i, column in enumerate(on)]
    joined = df.join(rows, matches, "inner" if mode == DROP else "left")
    if mode == FAIL:
        names = ", ".join(on)
        joined = joined.filter(
            F.when(F.col("_found").isNull(), F.raise_error(F.lit(f"lookup of {names} found no match"))).otherwise(True)
        )
    found = [F.col(f"_found.{column}").alias(name) for column, name in take.items()]
    kept = [F.col(c) for c in df.columns if c not in take.values()]
    return joined.select(*kept, *found)
