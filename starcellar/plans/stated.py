"""Measures the company names among its indicators without giving a formula; the definitions are ours."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starcellar.functions.money import as_double, ratio
from starcellar.plans.warehouse import Warehouse


def average_order_value(w: Warehouse) -> DataFrame:
    """Mean revenue per invoice by month."""
    by = ["YearNumber", "MonthNumber"]
    cells = w.slice("sales", by, {"revenue": "revenue"}, {"orders": "orders"})
    return cells.select(*by, "orders", ratio(F.col("revenue"), F.col("orders")).alias("average_order_value"))


def inventory_turnover(w: Warehouse) -> DataFrame:
    """Quantity sold at last cost over the value of the stock, by category.

    Quantities are summed per product before costs are joined; a category without stock value has no figure.
    """
    sold = w.totals("sales", ["ProductKey"], {"quantity": "quantity"})
    products = w.dimension("product").select("ProductKey", "Category")
    rows = w.stock().select("ProductKey", "CurrentStock", "LastCostPrice").join(products, "ProductKey").join(
        sold, "ProductKey", "left"
    )
    cost = F.col("LastCostPrice")
    totals = rows.groupBy("Category").agg(
        F.sum(F.coalesce(F.col("quantity"), F.lit(0)) * cost).alias("sold"),
        F.sum(F.col("CurrentStock") * cost).alias("held"),
    )
    return totals.select(
        "Category", as_double(F.col("sold")).alias("cost_of_sales"), as_double(F.col("held")).alias("stock_value"),
        ratio(F.col("sold"), F.col("held")).alias("turnover"),
    )


def stock_by_day(w: Warehouse, since: dt.date, until: dt.date) -> DataFrame:
    """Stock at the end of each day with a movement, ``since <= day < until``, rebuilt backwards from the present stock.

    What moved later is summed on two levels, so no group grows with a product's movements: days of a month inside the
    month, and months of a product over the months.
    """
    daily = w.totals("movements", ["ProductKey", "FullDate"], {"moved": "quantity"}, since=since)
    daily = daily.withColumn("month", F.trunc("FullDate", "MM"))
    later_months = Window.partitionBy("ProductKey").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    months = daily.groupBy("ProductKey", "month").agg(F.sum("moved").alias("of_month")).select(
        "ProductKey", "month", F.coalesce(F.sum("of_month").over(later_months), F.lit(0)).alias("after_month"))
    later_days = Window.partitionBy("ProductKey", "month").orderBy(F.desc("FullDate")).rowsBetween(
        Window.unboundedPreceding, -1)
    days = daily.filter(F.col("FullDate") < F.add_months(F.trunc(F.lit(until), "MM"), 1)).withColumn(
        "after_day", F.coalesce(F.sum("moved").over(later_days), F.lit(0)))
    stock = w.stock().select("ProductKey", "CurrentStock")
    rows = days.filter(F.col("FullDate") < F.lit(until)).join(months, ["ProductKey", "month"]).join(stock, "ProductKey")
    balance = F.col("CurrentStock") - F.col("after_month") - F.col("after_day")
    return rows.select("ProductKey", "FullDate", F.col("moved").cast("bigint").alias("moved"),
                       balance.cast("bigint").alias("balance"))


def stock_days(w: Warehouse, since: dt.date, until: dt.date) -> DataFrame:
    """By product, the end-of-day stock summed over all days of a period.

    A movement is missing from the stock of the days before it, so it takes part as often as the period has such days;
    that is one sum by product, and neither days nor products are multiplied.
    """
    length = (until - since).days
    before = F.least(F.date_diff("MovementDate", F.lit(since)), F.lit(length))
    moved = w.star("movements", ["ProductKey", "MovementDate", "Quantity"], since=since).groupBy("ProductKey").agg(
        F.sum(F.col("Quantity").cast("bigint") * before).alias("missing"))
    return w.stock().join(moved, "ProductKey", "left").select(
        "ProductKey", "LastCostPrice",
        (F.col("CurrentStock").cast("bigint") * length - F.coalesce("missing", F.lit(0))).alias("stock_days"))


def inventory_turnover_of(w: Warehouse, year: int) -> DataFrame:
    """Quantity sold in a year at last cost over the average value of that year's stock, by category."""
    since, until = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    sold = w.totals("sales", ["ProductKey"], {"quantity": "quantity"}, since, until)
    products = w.dimension("product").select("ProductKey", "Category")
    rows = stock_days(w, since, until).join(products, "ProductKey").join(sold, "ProductKey", "left")
    cost = F.col("LastCostPrice")
    totals = rows.groupBy("Category").agg(
        F.sum(F.coalesce(F.col("quantity"), F.lit(0)) * cost).alias("sold"),
        F.sum(F.col("stock_days").cast("decimal(18,0)") * cost).alias("held"))
    average = as_double(F.col("held")) / (until - since).days
    return totals.select("Category", as_double(F.col("sold")).alias("cost_of_sales"), average.alias("average_stock_value"),
                         F.try_divide(as_double(F.col("sold")), average).alias("turnover"))


def customer_growth(w: Warehouse) -> DataFrame:
    """New and returning customers by month: new in the month of their first invoice.

    Orders are reduced to one row per customer and month first, so the window over a customer is bounded by
    the number of months.
    """
    months = w.totals("sales", ["CustomerKey", "YearNumber", "MonthNumber"], {"line_count": "lines"})
    month = F.col("YearNumber") * 12 + F.col("MonthNumber")
    first = F.min(month).over(Window.partitionBy("CustomerKey"))
    marked = months.withColumn("is_new", month == first)
    return marked.groupBy("YearNumber", "MonthNumber").agg(
        F.count_if("is_new").alias("new_customers"), F.count_if(~F.col("is_new")).alias("returning_customers")
    )


def supplier_performance(w: Warehouse) -> DataFrame:
    """Spend, share of all spend, and order lines by supplier; the total is a scalar, not a window over all rows.

    The total names all columns of the rows it sums, so that Spark sees that both read the same sums by supplier.
    """
    spend = w.totals("purchases", ["SupplierKey", "SupplierName"], {"spend": "cost_at_last", "line_count": "lines"})
    same = F.struct(F.sum("spend").alias("spend"), F.sum("line_count"), F.max("SupplierKey"), F.max("SupplierName"))
    total = spend.agg(same).scalar()["spend"]
    return spend.select(
        "SupplierKey", "SupplierName", as_double(F.col("spend")).alias("spend"), "line_count",
        ratio(F.col("spend"), total).alias("spend_share"),
    )


def supplier_fulfilment(w: Warehouse, days: int = 60) -> DataFrame:
    """By supplier, order lines, average days from order to expected delivery, and the share of lines due within ``days``.

    Dates count as they stand: a line expected before it was ordered has a negative lead.
    """
    lead = F.date_diff("ExpectedDate", "PurchaseDate")
    lines = w.star("purchases", ["SupplierKey", "PurchaseDate", "ExpectedDate"]).groupBy("SupplierKey").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(lead).alias("lead"), F.count_if(lead <= days).alias("in_time"))
    return lines.select("SupplierKey", "line_count", ratio(F.col("lead"), F.col("line_count")).alias("lead_days"),
                        ratio(F.col("in_time"), F.col("line_count")).alias("share_in_time"))


def supplier_concentration(w: Warehouse, n: int = 20) -> DataFrame:
    """The ``n`` suppliers with the highest spend: share, share of all up to the rank, and the sum of all squared shares.

    Only the n rows are numbered in one place; both totals over all suppliers are scalars.
    """
    spend = w.totals("purchases", ["SupplierKey"], {"spend": "cost_at_last"})
    money = as_double(F.col("spend"))
    totals = spend.agg(F.struct(as_double(F.sum("spend")).alias("all"), F.sum(money * money).alias("squares"),
                                F.max("SupplierKey"))).scalar()
    first = spend.orderBy(F.desc("spend"), "SupplierKey").limit(n)
    ranked = Window.orderBy(F.desc("spend"), "SupplierKey")
    return first.select(
        F.row_number().over(ranked).alias("rank"), "SupplierKey", money.alias("spend"),
        (money / totals["all"]).alias("spend_share"),
        (as_double(F.sum("spend").over(ranked.rowsBetween(Window.unboundedPreceding, 0))) / totals["all"]).alias(
            "cumulative_share"),
        F.round(totals["squares"] / (totals["all"] * totals["all"]), 9).alias("concentration"))


def inventory_health(w: Warehouse) -> DataFrame:
    """Stock over reorder level by product, with a class: low, ok, or over the target."""
    stock, reorder = F.col("CurrentStock"), F.col("ReorderLevel")
    return w.stock().select(
        "ProductKey", "CurrentStock", "ReorderLevel", "TargetStockLevel",
        ratio(stock, reorder).alias("stock_ratio"),
        F.when(stock <= reorder, "low").when(stock > F.col("TargetStockLevel"), "over").otherwise("ok").alias("health"),
    )
