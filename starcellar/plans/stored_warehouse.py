"""The star written once and read many times: dimensions, and facts partitioned by year.

A load resolves all keys, drops what the lookups drop, and stores each fact with its dates.  Queries then
read a few columns of one fact, skip the years they do not need, and join dimensions only.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.plans.warehouse import DIMENSIONS, FACTS, Day, Fact, Warehouse, summed
from starcellar.sources.sinks import current_version, next_version, reload_sink, switch_version

YEAR = "LoadYear"
DATES = {"sales": "InvoiceDate", "purchases": "PurchaseDate", "movements": "MovementDate",
         "payments": "TransactionDate"}


def stored_facts() -> dict[str, Fact]:
    """Stored sales carry their profit, so it is a plain column there."""
    sales = FACTS["sales"]
    derived = {name: d for name, d in sales.derived.items() if name != "ProfitAmount"}
    return FACTS | {
        "sales": replace(
            sales, columns=(*sales.columns, "ProfitAmount"), derived=derived,
            measures={**sales.measures, "profit": summed("ProfitAmount")},
        )
    }


def store_warehouse(source: Warehouse, root: str) -> None:
    """Write all dimensions and facts as a new version below ``root``; readers see it when it is complete.

    ``rebalance`` groups rows by year into files of even size, splitting a year that holds most of the rows.
    """
    version = next_version(source.spark, root)
    target = f"{root}/{version}"
    for name in DIMENSIONS:
        reload_sink(source.dimension(name), f"{target}/dimension/{name}")
    reload_sink(source.stock(), f"{target}/stock")
    reload_sink(source.calendar_bounds(), f"{target}/calendar")
    for name, fact in stored_facts().items():
        rows = source.star(name, list(fact.columns)).withColumn(YEAR, F.year(DATES[name]))
        reload_sink(rows.hint("rebalance", YEAR), f"{target}/fact/{name}", (YEAR,))
    switch_version(source.spark, root, version)


class StoredWarehouse(Warehouse):
    facts = stored_facts()

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        version = current_version(spark, root)
        if version is None:
            raise FileNotFoundError(f"no warehouse stored below {root}")
        self.root = f"{root}/{version}"
        self._open: dict[str, DataFrame] = {}

    def _read(self, path: str) -> DataFrame:
        if path not in self._open:
            self._open[path] = self.spark.read.parquet(f"{self.root}/{path}")
        return self._open[path]

    def dimension(self, name: str) -> DataFrame:
        return self._read(f"dimension/{name}")

    def stock(self) -> DataFrame:
        return self._read("stock")

    def calendar_bounds(self) -> DataFrame:
        return self._read("calendar")

    def fact(
        self, name: str, columns: list[str], since: Day = None, until: Day = None, only: DataFrame | None = None
    ) -> DataFrame:
        rows, date = self._read(f"fact/{name}"), F.col(DATES[name])
        if since is not None:
            rows = rows.filter((F.col(YEAR) >= F.year(_day(since))) & (date >= _day(since)))
        if until is not None:
            rows = rows.filter((F.col(YEAR) <= F.year(_day(until))) & (date < _day(until)))
        if only is not None:
            rows = rows.join(F.broadcast(only), only.columns, "left_semi")
        return rows.select(*columns)


def _day(day: dt.date | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(day)
