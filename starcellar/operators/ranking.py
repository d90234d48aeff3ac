"""Top-n in its three forms.

None of them gathers the whole input: ``orderBy().limit()`` keeps n rows per task, the form with ties
compares with the n-th value, and the form per group lets Spark cut each group to n before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, by: str | Column, *ties: str, ascending: bool = False) -> DataFrame:
    """The ``n`` rows with the largest ``by``; equal values in the order of the ``ties`` columns."""
    value = F.col(by) if isinstance(by, str) else by
    return df.orderBy(value.asc() if ascending else value.desc(), *ties).limit(n)


def top_n_with_ties(df: DataFrame, n: int, by: str) -> DataFrame:
    """Every row whose ``by`` is at least the n-th largest value, so equal values are never cut."""
    nth = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by)).scalar()
    return df.filter(F.col(by) >= nth)


def top_n_per_group(df: DataFrame, groups: list[str], n: int, by: str, *ties: str) -> DataFrame:
    """The ``n`` rows with the largest ``by`` in each group, numbered from 1 in ``position``."""
    order = Window.partitionBy(*groups).orderBy(F.desc(by), *ties)
    return df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
