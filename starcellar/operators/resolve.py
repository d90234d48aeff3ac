"""Given tables reduced to the rows whose references all hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from starcellar.layout import Tables
from starcellar.sources.sinks import reload_sink


def resolve(tables: Tables, root: str) -> Tables:
    """The tables with orders of known customers and lines of known orders, products and suppliers only.

    This is what the operational database, which enforces these references, would have accepted.  The joins are made
    once, here, and their result is written below ``root``; every query over the returned tables then agrees with
    every other, whatever it groups by, without joining what it does not read.  A missing reference counts as broken.
    """
    def known(table: str, key: str, column: str):
        return tables.read(table).select(F.col(key).alias(column)).distinct()

    orders = tables.read("orders").join(known("customer", "c_custkey", "o_custkey"), "o_custkey", "left_semi")
    reload_sink(orders.select(*tables.read("orders").columns), f"{root}/orders.parquet")
    orders = tables.spark.read.parquet(f"{root}/orders.parquet")
    lines = tables.read("lineitem")
    for keys in (
        orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct(),
        known("part", "p_partkey", "l_partkey"), known("supplier", "s_suppkey", "l_suppkey"),
    ):
        lines = lines.join(keys, keys.columns[0], "left_semi")
    reload_sink(lines.select(*tables.read("lineitem").columns), f"{root}/lineitem.parquet")
    kept = {"orders": orders, "lineitem": tables.spark.read.parquet(f"{root}/lineitem.parquet")}
    return tables.replaced(**kept)
