"""Figures of the monthly executive report and of the advice snapshot.

Each figure exists for one month, as the report asks for it, and ``monthly_report`` has the figures of every month
at once, and the present stock's, instead of one query per month.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcellar.functions.calendar import month_range, previous_month
from starcellar.functions.money import as_double, margin_label
from starcellar.operators.ranking import top_n_per_group
from starcellar.plans.dashboard import LOW, MONTH, OVER, monthly, ranked, stock_with_names
from starcellar.plans.warehouse import Warehouse


def _month(year: int | None, month: int | None) -> dict:
    """The dates of a month, by default the one before today."""
    if year is None or month is None:
        year, month = previous_month(dt.date.today())
    since, until = month_range(year, month)
    return {"since": since, "until": until}


def month_totals(w: Warehouse, year: int | None = None, month: int | None = None) -> DataFrame:
    """Sales, profit and printed margin of one month; one row even for a month without sales."""
    totals = w.totals("sales", [], {"sales": "revenue", "profit": "profit"}, **_month(year, month))
    sales, profit = F.col("sales"), F.col("profit")
    return totals.select(
        as_double(sales).alias("sales"), as_double(profit).alias("profit"), margin_label(profit, sales).alias("margin")
    )


def month_top_products(w: Warehouse, year: int | None = None, month: int | None = None) -> DataFrame:
    return ranked(w, "sales", "Product", {"revenue": "revenue"}, 5, **_month(year, month))


def month_top_customers(w: Warehouse, year: int | None = None, month: int | None = None) -> DataFrame:
    return ranked(w, "sales", "CustomerName", {"revenue": "revenue"}, 5, "customer", **_month(year, month))


def month_top_suppliers(w: Warehouse, year: int | None = None, month: int | None = None) -> DataFrame:
    return ranked(w, "purchases", "SupplierName", {"spend": "cost_at_last"}, 5, "supplier", **_month(year, month))


def _stock_list(w: Warehouse, condition: str, level: str, order: Column) -> DataFrame:
    rows = stock_with_names(w, condition).select("ProductKey", "Product", "CurrentStock", level)
    return rows.orderBy(order, "Product", "ProductKey").limit(10).drop("ProductKey")


def month_low_stock(w: Warehouse) -> DataFrame:
    """Ten products at or below their reorder level, lowest stock first."""
    return _stock_list(w, LOW, "ReorderLevel", F.asc("CurrentStock"))


def month_overstock(w: Warehouse) -> DataFrame:
    """Ten products above their target, largest excess first."""
    return _stock_list(w, OVER, "TargetStockLevel", F.desc(F.col("CurrentStock") - F.col("TargetStockLevel")))


def advice_low_stock(w: Warehouse) -> DataFrame:
    """Ten products at or below their reorder level, largest deficit first."""
    return _stock_list(w, LOW, "ReorderLevel", F.desc(F.col("ReorderLevel") - F.col("CurrentStock")))


def advice_overstock(w: Warehouse) -> DataFrame:
    return month_overstock(w)


def monthly_report(w: Warehouse) -> DataFrame:
    """The figures of the report for every month and its two stock lists, one row per figure.

    Stock is what it is now, so its rows have no month; their amount is the stock.  ``section`` names the figure, ``position`` ranks it within the month.  Names are ranked after they
    are summed per month; Spark cuts each month to five names before the ranking shuffle.
    """

    def section(name: Column, df: DataFrame, label: str, value: str) -> DataFrame:
        return df.select(
            F.col("YearNumber").alias("yr"), F.col("MonthNumber").alias("mo"), name.alias("section"),
            F.col("position"), F.col(label).alias("label"), as_double(F.col(value)).alias("amount"),
        )

    def best(name: str, fact: str, attribute: str, measure: str) -> DataFrame:
        totals = w.totals(fact, [*MONTH, attribute], {"amount": measure})
        return section(F.lit(name), top_n_per_group(totals, MONTH, 5, "amount", attribute), attribute, "amount")

    totals = w.totals("sales", MONTH, {"sales": "revenue", "profit": "profit"})
    figures = F.explode(F.create_map(F.lit("sales"), F.col("sales"), F.lit("profit"), F.col("profit")))
    margin = margin_label(F.col("profit"), F.col("sales")).alias("label")
    totals = totals.select(*MONTH, margin, figures.alias("section", "amount"))
    parts = [
        section(F.col("section"), totals.withColumn("position", F.lit(1)), "label", "amount"),
        best("top_products", "sales", "Product", "revenue"),
        best("top_customers", "sales", "CustomerName", "revenue"),
        best("top_suppliers", "purchases", "SupplierName", "cost_at_last"),
    ]
    for name, rows in (("low_stock", month_low_stock(w)), ("overstock", month_overstock(w))):
        level = [c for c in rows.columns if c not in ("Product", "CurrentStock")][0]
        gap = F.asc("CurrentStock") if name == "low_stock" else F.desc(F.col("CurrentStock") - F.col(level))
        place = F.row_number().over(Window.orderBy(gap, "Product"))  # ten rows
        none = F.lit(None).cast("int")
        parts.append(section(F.lit(name), rows.withColumns({
            "position": place, "YearNumber": none, "MonthNumber": none}), "Product", "CurrentStock"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def recent_trend(w: Warehouse) -> DataFrame:
    """The last six months with sales, newest first."""
    trend = monthly(w, "sales", {"revenue": "revenue", "profit": "profit"})
    return trend.orderBy(F.desc("yr"), F.desc("mo")).limit(6).select("period", "revenue", "profit")


def advice_top_products(w: Warehouse) -> DataFrame:
    return ranked(w, "sales", "Product", {"revenue": "revenue", "profit": "profit"}, 5)


def advice_top_customers(w: Warehouse) -> DataFrame:
    return ranked(w, "sales", "CustomerName", {"revenue": "revenue"}, 5, "customer")


def advice_top_suppliers(w: Warehouse) -> DataFrame:
    return ranked(w, "purchases", "SupplierName", {"spend": "cost_at_last"}, 5, "supplier")

