"""Queries behind the dashboard pages: headline figures, trends, rankings, stock, purchasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.functions.calendar import period_label, year_range
from starcellar.functions.money import as_double, margin_percent
from starcellar.operators.ranking import top_n
from starcellar.plans.warehouse import Warehouse

MONTH = ["YearNumber", "MonthNumber"]


def _year(year: int | None) -> dict:
    if year is None:
        return {}
    since, until = year_range(year)
    return {"since": since, "until": until}


def _doubles(*names: str) -> list[Column]:
    return [as_double(F.col(name)).alias(name) for name in names]


# Headline figures ------------------------------------------------------------------------------------


def kpis(w: Warehouse) -> DataFrame:
    """Total sales, profit, orders and purchases, margin and the number of low-stock products, in one row."""
    sales = w.totals("sales", [], {"total_sales": "revenue", "total_profit": "profit"})
    orders = w.distinct_counts("sales", [], {"total_orders": "orders"})
    purchases = w.totals("purchases", [], {"total_purchases": "cost_at_last"})
    low = w.stock().filter("CurrentStock <= ReorderLevel").agg(F.count(F.lit(1)).alias("low_stock_count"))
    return sales.select(
        *_doubles("total_sales", "total_profit"),
        orders.scalar().alias("total_orders"),
        as_double(purchases.scalar()).alias("total_purchases"),
        margin_percent(F.col("total_profit"), F.col("total_sales")).alias("profit_margin"),
        low.scalar().alias("low_stock_count"),
    )


# Trends ----------------------------------------------------------------------------------------------


def monthly(w: Warehouse, fact: str, measures: dict[str, str], year: int | None = None, **period) -> DataFrame:
    """Measures by month, labelled ``January 2016`` once per month, with year and month to sort by."""
    totals = w.totals(fact, MONTH, measures, **(period or _year(year)))
    return totals.select(
        period_label(F.make_date("YearNumber", "MonthNumber", F.lit(1))).alias("period"),
        F.col("YearNumber").alias("yr"),
        F.col("MonthNumber").alias("mo"),
        *_doubles(*measures),
    )


def revenue_trend(w: Warehouse) -> DataFrame:
    return monthly(w, "sales", {"revenue": "revenue"}).orderBy("yr", "mo")


def sales_trend(w: Warehouse, year: int | None = None) -> DataFrame:
    return monthly(w, "sales", {"revenue": "revenue", "profit": "profit"}, year).orderBy("yr", "mo")


def purchase_trend(w: Warehouse, year: int | None = None) -> DataFrame:
    return monthly(w, "purchases", {"total_cost": "cost_at_last"}, year).orderBy("yr", "mo")


# Rankings; names group, so equal names merge ---------------------------------------------------------


def ranked(
    w: Warehouse, fact: str, attribute: str, measures: dict[str, str], n: int, label: str | None = None, **period
) -> DataFrame:
    """The ``n`` members of an attribute with the largest first measure, ties by name."""
    label = label or attribute
    totals = w.totals(fact, [attribute], measures, **period)
    best = top_n(totals.withColumnRenamed(attribute, label), n, next(iter(measures)), label)
    return best.select(label, *_doubles(*measures))


def top_products_revenue(w: Warehouse) -> DataFrame:
    return ranked(w, "sales", "Product", {"revenue": "revenue"}, 8)


def top_products(w: Warehouse, year: int | None = None, n: int = 10) -> DataFrame:
    return ranked(w, "sales", "Product", {"revenue": "revenue", "profit": "profit"}, n, **_year(year))


def top_customers(w: Warehouse, year: int | None = None, n: int = 10) -> DataFrame:
    return ranked(w, "sales", "CustomerName", {"revenue": "revenue"}, n, "customer", **_year(year))


def sales_by_category(w: Warehouse, year: int | None = None) -> DataFrame:
    totals = w.totals("sales", ["Category"], {"revenue": "revenue", "profit": "profit"}, **_year(year))
    return totals.select("Category", *_doubles("revenue", "profit")).orderBy(F.desc("revenue"), "Category")


def years(w: Warehouse) -> DataFrame:
    """Every year of the calendar, newest first: a sequence between its bounds, no scan of the days."""
    bounds = w.calendar_bounds().select(F.sequence(F.year("first_day"), F.year("last_day")).alias("years"))
    return bounds.select(F.explode("years").alias("year")).orderBy(F.desc("year"))


def top_suppliers(w: Warehouse, year: int | None = None, n: int = 10) -> DataFrame:
    """Suppliers by spend with the number of their purchase orders.

    Spend is summed by supplier and product before prices are joined; orders are counted for the
    chosen suppliers only.
    """
    period = _year(year)
    spend = w.totals("purchases", ["SupplierName"], {"total_spend": "cost_at_last"}, **period)
    best = top_n(spend, n, "total_spend", "SupplierName")
    members = w.dimension("supplier").join(F.broadcast(best), "SupplierName")
    lines = w.fact("purchases", ["SupplierKey", "PurchaseOrderID"], **period)
    rows = lines.join(members.select("SupplierKey", "SupplierName", "total_spend"), "SupplierKey")
    counted = rows.groupBy("SupplierName", "total_spend").agg(F.count_distinct("PurchaseOrderID").alias("orders"))
    return counted.select(
        F.col("SupplierName").alias("supplier"), *_doubles("total_spend"), "orders"
    ).orderBy(F.desc("total_spend"), "supplier")


def top_purchased(w: Warehouse) -> DataFrame:
    totals = w.totals("purchases", ["Product"], {"total_cost": "cost_at_last", "qty": "quantity_ordered"})
    return top_n(totals, 10, "total_cost", "Product").select("Product", "qty", *_doubles("total_cost"))


def products_sold(w: Warehouse, limit: int | None = None) -> DataFrame:
    """Products with at least one sale.  Sold keys are made distinct before the join, so a best-seller is one row."""
    sold = w.fact("sales", ["ProductKey"]).distinct()
    products = w.dimension("product").select("ProductKey", F.col("Product").alias("product_name"))
    listed = products.join(sold, "ProductKey", "left_semi").orderBy("product_name", "ProductKey")
    return listed if limit is None else listed.limit(limit)


# Stock -----------------------------------------------------------------------------------------------

LOW = "CurrentStock <= ReorderLevel"
OVER = "CurrentStock > TargetStockLevel"


def stock_with_names(w: Warehouse, condition: str, *attributes: str) -> DataFrame:
    """Stock rows meeting the condition, with product attributes; the filter runs before the join."""
    products = w.dimension("product").select("ProductKey", *unique_names(attributes))
    return w.stock().filter(condition).join(products, "ProductKey")


def unique_names(attributes: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(("Product", *attributes)))


def low_stock(w: Warehouse, n: int = 20) -> DataFrame:
    """Products at or below their reorder level, largest deficit first."""
    rows = stock_with_names(w, LOW).select(
        "ProductKey", "Product", "CurrentStock", "ReorderLevel",
        (F.col("ReorderLevel") - F.col("CurrentStock")).alias("deficit"),
    )
    return top_n(rows, n, "deficit", "Product", "ProductKey").drop("ProductKey")


def stock_alerts(w: Warehouse) -> DataFrame:
    return low_stock(w, 5)


def overstock(w: Warehouse, n: int = 20) -> DataFrame:
    """Products above their target level, largest excess first."""
    rows = stock_with_names(w, OVER).select(
        "ProductKey", "Product", "CurrentStock", "TargetStockLevel",
        (F.col("CurrentStock") - F.col("TargetStockLevel")).alias("excess"),
    )
    return top_n(rows, n, "excess", "Product", "ProductKey").drop("ProductKey")


def inventory_value(w: Warehouse) -> DataFrame:
    """Stock at last cost by category; products are unique, so nothing can be summed before the join."""
    value = F.sum(F.col("CurrentStock") * F.col("LastCostPrice"))
    products = w.dimension("product").select("ProductKey", "Category")
    return (
        w.stock().join(products, "ProductKey").groupBy("Category")
        .agg(as_double(value).alias("inv_value")).orderBy(F.desc("inv_value"), "Category")
    )


def weekly_low_stock(w: Warehouse) -> DataFrame:
    """Every product at or below its reorder level, for the weekly alert."""
    return stock_with_names(w, LOW, "Category").select(
        "ProductKey", "Product", "Category", "CurrentStock", "ReorderLevel", "TargetStockLevel"
    )

