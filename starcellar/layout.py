"""The given tables seen as the operational tables of a trading company.

An order is an invoice and a purchase order at once, a line item is a line of both, a part is a product.
Natural keys stand in for surrogate keys, so results do not depend on the order of key assignment.
Every function is a projection: Spark reads only the columns a query ends up using.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.sources.files import table_source


def cents(column: str) -> str:
    """An amount or rate with two decimals, given as a double, in whole hundredths: exact, and cheap to multiply."""
    return f"CAST(rint({column} * 100) AS BIGINT)"


def hundredths(whole: str, precision: int = 18) -> str:
    """Whole hundredths as a decimal with two decimals."""
    return f"CAST(CAST({whole} AS DECIMAL(18,0)) * 0.01BD AS DECIMAL({precision},2))"


def amount(column: str) -> str:
    return hundredths(cents(column))


def _timestamp(day: dt.date | Column) -> Column:
    return (day if isinstance(day, Column) else F.lit(day)).cast("timestamp_ntz")


def within(column: str, since: dt.date | Column | None, until: dt.date | Column | None) -> Column:
    """``since <= column < until`` on the stored timestamp itself, so that the Parquet scan can skip on it."""
    condition = F.lit(True)
    if since is not None:
        condition = condition & (F.col(column) >= _timestamp(since))
    if until is not None:
        condition = condition & (F.col(column) < _timestamp(until))
    return condition


class Tables:
    """The given tables in one folder, each as the relations it stands for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The table as given; its files are listed once per instance."""
        if name not in self._open:
            self._open[name] = table_source(self.spark, self.folder, name)
        return self._open[name]

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same tables with some of them given as frames."""
        other = Tables(self.spark, self.folder)
        other._open = {**self._open, **tables}
        return other

    # Sales and purchases -------------------------------------------------------------------------

    def order_heads(self, since=None, until=None) -> DataFrame:
        """One row per order: the head of an invoice and of a purchase order."""
        return self.read("orders").filter(within("o_orderdate", since, until)).selectExpr(
            "o_orderkey AS OrderKey",
            "o_custkey AS CustomerKey",
            "o_orderpriority AS EmployeeKey",
            "o_orderstatus AS OrderStatus",
            "CAST(o_orderdate AS DATE) AS OrderDate",
            f"{amount('o_totalprice')} AS OrderAmount",
        )

    def order_lines(self, also: tuple[str, ...] = ()) -> DataFrame:
        """One row per line item with exact amounts; what a line earns is known once its cost is joined.

        A line's total is a product of hundredths, so it has four decimals.  ``also``: given columns carried along, or
        ``LineID``, a hash of the line, as its given number is not its own.
        """
        given = [c for c in self.read("lineitem").columns if c.startswith("l_")]
        more = [f"xxhash64({', '.join(given)}) AS LineID" if c == "LineID" else c for c in also]
        total = f"{cents('l_extendedprice')} * (100 - {cents('l_discount')})"
        unit_price = f"{cents('l_extendedprice')} div NULLIF(CAST(l_quantity AS BIGINT), 0)"
        return self.read("lineitem").selectExpr(
            "l_orderkey AS OrderKey",
            "l_partkey AS ProductKey",
            "l_suppkey AS SupplierKey",
            "l_linestatus AS DeliveryMethodKey",
            "l_returnflag AS TransactionTypeKey",
            "CAST(l_quantity AS INT) AS Quantity",
            f"{hundredths(unit_price)} AS UnitPrice",
            f"{amount('l_extendedprice')} AS ListAmount",
            f"CAST({cents('l_tax')} AS DECIMAL(5,2)) AS TaxRate",
            f"CAST(CAST({total} AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4)) AS LineTotal",
            "l_shipdate", *more,
        )

    def calendar_bounds(self) -> DataFrame:
        """First and last day of the calendar: one row from one column of the orders."""
        return self.read("orders").agg(
            F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day")
        )

    # Dimensions ----------------------------------------------------------------------------------

    def products(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey AS ProductKey",
            "p_partkey AS ProductID",
            "p_name AS Product",
            "p_type AS Category",
            "CASE WHEN p_name LIKE '% %' THEN substring_index(p_name, ' ', 1) END AS Color",
            "p_brand AS Brand",
            f"{amount('p_retailprice')} AS LastCostPrice",
        )

    def customers(self) -> DataFrame:
        return self.read("customer").selectExpr(
            "c_custkey AS CustomerKey",
            "c_custkey AS CustomerID",
            "c_name AS CustomerName",
            "c_mktsegment AS CustomerCategory",
            "CAST(NULL AS STRING) AS BuyingGroup",
            "c_nationkey AS LocationKey",
        )

    def suppliers(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey AS SupplierKey",
            "s_suppkey AS SupplierID",
            "s_name AS SupplierName",
            "CASE WHEN s_acctbal < 5000 THEN 'Standard' ELSE 'Preferred' END AS SupplierCategory",
            "s_nationkey AS LocationKey",
        )

    def locations(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
            "n_nationkey AS LocationKey",
            "n_nationkey AS CityID",
            "n_name AS City",
            "r_name AS State",
            "r_name AS Country",
            "r_name AS Continent",
        )

    # Stock and payments --------------------------------------------------------------------------

    def stock(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey AS ProductKey",
            "CAST(p_partkey * 7 % 100 AS INT) AS CurrentStock",
            "p_size AS ReorderLevel",
            "p_size * 2 AS TargetStockLevel",
            f"{amount('p_retailprice')} AS LastCostPrice",
        )

    def customer_payments(self, since=None, until=None) -> DataFrame:
        paid = amount("o_totalprice")
        return self.read("orders").filter(within("o_orderdate", since, until)).selectExpr(
            "CAST(o_orderdate AS DATE) AS TransactionDate",
            "o_custkey AS CustomerID",
            "o_orderkey AS InvoiceID",
            "o_orderpriority AS PaymentMethodID",
            "o_orderstatus AS TransactionTypeID",
            f"{paid} AS NetAmount",
            "CAST(0 AS DECIMAL(18,2)) AS TaxAmount",
            f"{paid} AS TransactionAmount",
            f"CASE WHEN o_orderstatus = 'O' THEN {paid} ELSE CAST(0 AS DECIMAL(18,2)) END AS RemainingBalance",
        )

    def supplier_payments(self, since=None, until=None) -> DataFrame:
        """Payments of lines; tax is a product of hundredths, so tax and net have four decimals."""
        paid = amount("l_extendedprice")
        tax = f"CAST({cents('l_extendedprice')} * {cents('l_tax')} AS DECIMAL(18,0)) * 0.0001BD"
        net = f"CAST({cents('l_extendedprice')} * (100 - {cents('l_tax')}) AS DECIMAL(18,0)) * 0.0001BD"
        return self.read("lineitem").filter(within("l_shipdate", since, until)).selectExpr(
            "CAST(l_shipdate AS DATE) AS TransactionDate",
            "l_suppkey AS SupplierID",
            "l_orderkey AS PurchaseOrderID",
            "CAST(NULL AS STRING) AS PaymentMethodID",
            "l_returnflag AS TransactionTypeID",
            f"CAST({net} AS DECIMAL(18,4)) AS NetAmount",
            f"CAST({tax} AS DECIMAL(18,4)) AS TaxAmount",
            f"{paid} AS TransactionAmount",
            f"CASE WHEN l_linestatus = 'O' THEN {paid} ELSE CAST(0 AS DECIMAL(18,2)) END AS RemainingBalance",
        )
