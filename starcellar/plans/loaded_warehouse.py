"""The star as ``StarLoad`` leaves it, for every query: surrogate keys, one snapshot, years that a query skips."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.functions.calendar import date_key
from starcellar.plans.star_load import YEAR
from starcellar.plans.stored_warehouse import stored_facts
from starcellar.plans.warehouse import Day, Fact, Warehouse
from starcellar.sources.snapshots import Snapshot, Snapshots

TABLES = {
    "product": "DimProduct", "customer": "DimCustomer", "supplier": "DimSupplier", "location": "DimLocation",
    "employee": "DimEmployee", "delivery": "DimDeliveryMethod", "type": "DimTransactionType",
    "payment": "DimPaymentMethod", "sales": "FactSales", "purchases": "FactPurchases",
    "movements": "FactInventoryTransactions", "payments": "FactFinancialTransactions",
}
# Dates of a fact and the keys they are stored as; the first is the one that years follow.
DATE_KEYS = {
    "sales": {"InvoiceDate": "InvoiceDateKey"},
    "purchases": {"PurchaseDate": "PurchaseDateKey", "ExpectedDate": "ExpectedDeliveryDateKey"},
    "movements": {"MovementDate": "DateKey"},
    "payments": {"TransactionDate": "TransactionDate"},
}
NAMES = ("FullName", "DeliveryMethod", "TransactionType")  # here columns of a dimension, found by its key


def _loaded_facts() -> dict[str, Fact]:
    return {
        name: replace(fact, derived={n: d for n, d in fact.derived.items() if n not in NAMES})
        for name, fact in stored_facts().items()
    }


def _day(key: str) -> Column:
    """The date of a date key."""
    k = F.col(key)
    return F.make_date(F.floor(k / 10000).cast("int"), F.floor(k / 100).cast("int") % 100, k % 100)


class LoadedWarehouse(Warehouse):
    """Reads the snapshot given or current when it was opened, so all its queries agree while loads go on."""

    facts = _loaded_facts()

    def __init__(self, store: Snapshots, snapshot: Snapshot | None = None):
        super().__init__(store.spark)
        self.store, self.snapshot = store, snapshot or store.current()
        if not self.snapshot.number:
            raise FileNotFoundError(f"no star loaded below {store.root}")

    def _read(self, table: str) -> DataFrame:
        return self.store.read(table, self.snapshot).drop("part")

    def dimension(self, name: str) -> DataFrame:
        """All members, those gone since included, as facts may name them."""
        if name in ("customer_place", "supplier_place"):
            return self.place(name.removesuffix("_place"), name.removesuffix("_place").capitalize())
        return self._read(TABLES[name])

    def stock(self) -> DataFrame:
        return self._read("FactInventory")

    def calendar_bounds(self) -> DataFrame:
        return self._read("DimDate").agg(F.min("FullDate").alias("first_day"), F.max("FullDate").alias("last_day"))

    def fact(
        self, name: str, columns: list[str], since: Day = None, until: Day = None, only: DataFrame | None = None
    ) -> DataFrame:
        rows, dates = self._read(TABLES[name]), DATE_KEYS[name]
        key = next(iter(dates.values()))

        def stored(day: Day) -> Column:
            day = day if isinstance(day, Column) else F.lit(day)
            return date_key(day) if key.endswith("Key") else day

        def year(day: Day) -> Column:
            return F.year(day) if isinstance(day, Column) else F.lit(day.year)

        if since is not None:
            rows = rows.filter((F.col(YEAR) >= year(since)) & (F.col(key) >= stored(since)))
        if until is not None:
            rows = rows.filter((F.col(YEAR) <= year(until)) & (F.col(key) < stored(until)))
        rows = rows.select(*(_day(dates[c]).alias(c) if dates.get(c, c) != c else F.col(c)
                             for c in dict.fromkeys([*columns, *(only.columns if only is not None else [])])))
        if only is not None:
            rows = rows.join(only, only.columns, "left_semi")
        return rows.select(*columns)
