"""Validation of keys, mandatory columns, references, value checks and text lengths."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.schemas import Rules

REPORT = ("table_name", "rule", "column_name", "violations")


def _labelled(df: DataFrame, table: str, rule: str, column: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"),
        F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"),
    )


def row_violations(df: DataFrame, table: str, rules: Rules) -> DataFrame | None:
    """NOT NULL, value and length rules: one pass over the table counts them all."""
    counts = {}
    for column in rules.required:
        counts["not_null", column] = F.count_if(F.col(column).isNull())
    for name, condition in rules.checks.items():
        counts["check", name] = F.count_if(~F.expr(condition))
    for column, length in rules.lengths.items():
        counts["length", column] = F.count_if(F.length(column) > length)
    if not counts:
        return None
    cells = F.explode(
        F.array(*(
            F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.col(f"c{i}").alias("violations"))
            for i, (rule, column) in enumerate(counts)
        ))
    ).alias("cell")
    totals = df.agg(*(count.alias(f"c{i}") for i, count in enumerate(counts.values())))
    return totals.select(cells).select(F.lit(table).alias("table_name"), "cell.*").select(*REPORT)


def key_violations(df: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    """Rows whose key is not theirs alone, and rows without a key."""
    copies = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    bad = copies.filter((F.col("copies") > 1) | missing).agg(F.sum("copies").alias("violations"))
    return _labelled(bad, table, "primary_key", ", ".join(key))


def reference_violations(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent; rows are counted per value first, so a frequent value is one row."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    known = parent.select(F.col(parent_key).alias("value"))
    orphans = values.join(known, "value", "left_anti").agg(F.sum("copies").alias("violations"))
    return _labelled(orphans, table, "foreign_key", column)


def constraint_report(tables: Mapping[str, DataFrame], rules: Mapping[str, Rules]) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    parts = []
    for table, rule in rules.items():
        df = tables[table]
        key = (rule.key,) if isinstance(rule.key, str) else tuple(rule.key)
        parts.append(key_violations(df, table, key))
        checked = row_violations(df, table, rule)
        parts += [checked] if checked is not None else []
        for column, (parent, parent_key) in rule.references.items():
            parts.append(reference_violations(df, table, column, tables[parent], parent_key))
    return reduce(DataFrame.unionByName, parts)


def require_valid(tables: Mapping[str, DataFrame], rules: Mapping[str, Rules]) -> None:
    """Raise with the broken rules, if any; the report has one row per rule."""
    broken = constraint_report(tables, rules).filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r.table_name}.{r.column_name} {r.rule}: {r.violations} rows" for r in broken))
