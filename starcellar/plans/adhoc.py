"""Questions asked of the warehouse in the past, and a way to ask new ones in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.functions.money import as_double, ratio, ratio_or_zero
from starcellar.operators.ranking import top_n
from starcellar.plans.dashboard import LOW, monthly, ranked, stock_with_names
from starcellar.plans.warehouse import Warehouse
from starcellar.sources.files import QUESTION_ROWS, limited_fetch

CUSTOMER = ["CustomerKey", "CustomerID", "CustomerName"]


def _doubles(*names: str):
    return [as_double(F.col(n)).alias(n) for n in names]


# Customers -------------------------------------------------------------------------------------------


def customers_this_year(w: Warehouse, n: int = 5) -> DataFrame:
    """Top customers by name in the calendar's last year; the year is a scalar subquery that reaches the scan."""
    totals = w.totals("sales", ["CustomerName"], {"TotalSales": "revenue"}, since=w.latest_year_start())
    return top_n(totals, n, "TotalSales", "CustomerName").select("CustomerName", *_doubles("TotalSales"))


def best_customers(w: Warehouse, n: int, since=None) -> DataFrame:
    """The ``n`` customers, by key, with the largest revenue: a few rows, found on revenue alone."""
    totals = w.totals("sales", CUSTOMER, {"TotalRevenue": "revenue"}, since=since)
    return top_n(totals, n, "TotalRevenue", "CustomerName", "CustomerKey")


def sales_of(w: Warehouse, customers: DataFrame, columns: list[str], since=None) -> DataFrame:
    """Sales rows of a handful of customers; ``customers`` is cut to n rows before, as ``best_customers`` is."""
    return w.star("sales", ["CustomerKey", *columns], since, only=customers.select("CustomerKey"))


def customers_this_year_cte(w: Warehouse, n: int = 5) -> DataFrame:
    """Top customers by key in the last year with profit and number of orders."""
    since = w.latest_year_start()
    best = best_customers(w, n, since)
    figures = sales_of(w, best, ["InvoiceID", "ProfitAmount"], since).groupBy("CustomerKey").agg(
        F.sum("ProfitAmount").alias("TotalProfit"), F.count_distinct("InvoiceID").alias("OrderCount")
    )
    return best.join(figures, "CustomerKey").select(
        "CustomerID", "CustomerName", *_doubles("TotalRevenue", "TotalProfit"), "OrderCount"
    ).orderBy(F.desc("TotalRevenue"), "CustomerName")


def top_customers_by_key(w: Warehouse, n: int = 5) -> DataFrame:
    best = best_customers(w, n)
    return best.select("CustomerID", "CustomerName", *_doubles("TotalRevenue"))


def top_customers_by_key_lines(w: Warehouse, n: int = 5) -> DataFrame:
    """As above with profit, and the number of lines under the name the question used."""
    best = best_customers(w, n)
    figures = sales_of(w, best, ["ProfitAmount"]).groupBy("CustomerKey").agg(
        F.sum("ProfitAmount").alias("TotalProfit"), F.count(F.lit(1)).alias("OrderCount")
    )
    return best.join(figures, "CustomerKey").select(
        "CustomerID", "CustomerName", *_doubles("TotalRevenue", "TotalProfit"), "OrderCount"
    ).orderBy(F.desc("TotalRevenue"), "CustomerName")


def customer_metrics(w: Warehouse, n: int = 5) -> DataFrame:
    """Revenue, profit, quantity, orders, products, margin, average order and unit price of the top customers."""
    best = best_customers(w, n)
    rows = sales_of(w, best, ["InvoiceID", "ProductKey", "Quantity", "ProfitAmount"])
    figures = rows.groupBy("CustomerKey").agg(
        F.sum("ProfitAmount").alias("TotalProfit"),
        F.sum("Quantity").alias("TotalQuantity"),
        F.count_distinct("InvoiceID").alias("OrderCount"),
        F.count_distinct("ProductKey").alias("DistinctProducts"),
    )
    revenue = F.col("TotalRevenue")
    return best.join(figures, "CustomerKey").select(
        "CustomerID", "CustomerName", *_doubles("TotalRevenue", "TotalProfit"),
        "TotalQuantity", "OrderCount", "DistinctProducts",
        ratio_or_zero(F.col("TotalProfit"), revenue).alias("ProfitMargin"),
        ratio_or_zero(revenue, F.col("OrderCount")).alias("AvgOrderValue"),
        ratio_or_zero(revenue, F.col("TotalQuantity")).alias("AvgUnitPrice"),
    ).orderBy(F.desc("TotalRevenue"), "CustomerName")


def customer_retention(w: Warehouse, n: int = 5) -> DataFrame:
    """Top customers with their last purchase and the category they spend most on."""
    best = best_customers(w, n)
    rows = sales_of(w, best, ["InvoiceID", "InvoiceDate", "LineTotal", "ProfitAmount", "Category"])
    # One pass: the chosen customers' lines by category and by order, then both sides folded by customer.
    cells = rows.groupingSets(
        [["CustomerKey", "Category"], ["CustomerKey", "InvoiceID"]], "CustomerKey", "Category", "InvoiceID"
    ).agg(
        F.sum("ProfitAmount").alias("profit"), F.sum("LineTotal").alias("spent"), F.count("LineTotal").alias("lines"),
        F.max("InvoiceDate").alias("latest"), (F.grouping("Category") == 1).alias("by_order"),
    )
    order, category = F.col("by_order"), ~F.col("by_order")
    figures = cells.groupBy("CustomerKey").agg(
        F.sum(F.when(order, F.col("profit"))).alias("TotalProfit"),
        F.count_if(order).alias("OrderCount"),
        F.sum(F.when(order, F.col("spent"))).alias("spent"),
        F.sum(F.when(order, F.col("lines"))).alias("lines"),
        F.max("latest").alias("LastPurchaseDate"),
        F.min_by(F.struct("Category", "spent"), F.when(category, F.struct(-F.col("spent"), "Category"))).alias("favourite"),
    ).withColumns({"TopCategory": F.col("favourite.Category"), "TopCategoryRevenue": F.col("favourite.spent")})
    return best.join(figures, "CustomerKey").select(
        "CustomerID", "CustomerName", *_doubles("TotalRevenue", "TotalProfit"), "OrderCount",
        ratio(F.col("spent"), F.col("lines")).alias("AvgOrderValue"),
        "LastPurchaseDate", "TopCategory", *_doubles("TopCategoryRevenue"),
    ).orderBy(F.desc("TotalRevenue"), "CustomerName")


# Years -----------------------------------------------------------------------------------------------


def _last_two_years(w: Warehouse) -> DataFrame:
    year_before = w.calendar_bounds().select(F.add_months(F.trunc("last_day", "YEAR"), -12)).scalar()
    return w.totals("sales", ["YearNumber"], {"Revenue": "revenue"}, since=year_before)


def year_vs_last(w: Warehouse) -> DataFrame:
    """Revenue of the calendar's last year and of the one before, side by side; NULL for a year without sales."""
    year = w.calendar_bounds().select(F.year("last_day").alias("CurrentYear"))
    revenue = _last_two_years(w)
    current = revenue.select(F.col("YearNumber").alias("CurrentYear"), F.col("Revenue").alias("CurrentYearRevenue"))
    last = revenue.select(F.col("YearNumber").alias("LastYear"), F.col("Revenue").alias("LastYearRevenue"))
    both = year.withColumn("LastYear", F.col("CurrentYear") - 1)
    both = both.join(current, "CurrentYear", "left").join(last, "LastYear", "left")
    return both.select("CurrentYear", *_doubles("CurrentYearRevenue"), "LastYear", *_doubles("LastYearRevenue"))


def year_vs_last_rows(w: Warehouse) -> DataFrame:
    """The same as rows, newest first."""
    return _last_two_years(w).select("YearNumber", *_doubles("Revenue")).orderBy(F.desc("YearNumber"))


# Categories and stock --------------------------------------------------------------------------------


def category_margin(w: Warehouse) -> DataFrame:
    """Profit, revenue and margin by category, margin 0 without revenue."""
    totals = w.totals("sales", ["Category"], {"TotalProfit": "profit", "TotalRevenue": "revenue"})
    return totals.select(
        "Category", *_doubles("TotalProfit", "TotalRevenue"),
        ratio_or_zero(F.col("TotalProfit"), F.col("TotalRevenue")).alias("ProfitMargin"),
    ).orderBy(F.desc("ProfitMargin"), "Category")


def best_margin_category(w: Warehouse) -> DataFrame:
    return top_n(category_margin(w).select("Category", "ProfitMargin"), 1, "ProfitMargin", "Category")


def category_profile(w: Warehouse) -> DataFrame:
    """Revenue, profit, margin, quantity, average price and tax by category in the calendar's last year."""
    measures = {"TotalRevenue": "revenue", "TotalProfit": "profit", "TotalQuantity": "quantity",
                "prices": "unit_price", "rates": "tax_rate", "lines": "lines"}
    totals = w.totals("sales", ["Category"], measures, since=w.latest_year_start())
    return totals.select(
        "Category", *_doubles("TotalRevenue", "TotalProfit"),
        ratio_or_zero(F.col("TotalProfit"), F.col("TotalRevenue")).alias("ProfitMargin"),
        "TotalQuantity",
        ratio(F.col("prices"), F.col("lines")).alias("AvgUnitPrice"),
        ratio(F.col("rates"), F.col("lines")).alias("AvgTaxRate"),
    ).orderBy(F.desc("TotalRevenue"), "Category")


def stock_risk(w: Warehouse) -> DataFrame:
    """Products at or below their reorder level with details, lowest stock first."""
    return stock_with_names(w, LOW, "ProductID", "Category").select(
        "ProductKey", "ProductID", "Product", "Category", "CurrentStock", "ReorderLevel", "TargetStockLevel"
    ).orderBy("CurrentStock", "Product", "ProductKey")


# Example questions -----------------------------------------------------------------------------------


def example_top_customers(w: Warehouse) -> DataFrame:
    return ranked(w, "sales", "CustomerName", {"revenue": "revenue"}, 5, "customer")


def example_top_products(w: Warehouse) -> DataFrame:
    return ranked(w, "sales", "Product", {"revenue": "revenue"}, 10)


def example_reorder(w: Warehouse) -> DataFrame:
    rows = stock_with_names(w, LOW)
    return rows.orderBy(F.desc(F.col("ReorderLevel") - F.col("CurrentStock")), "Product", "ProductKey").select(
        "Product", "CurrentStock", "ReorderLevel"
    )


def example_supplier_spend(w: Warehouse) -> DataFrame:
    """Top suppliers by cost at order in the calendar's last year."""
    return ranked(w, "purchases", "SupplierName", {"total_spend": "cost_at_order"}, 10, "supplier",
                  since=w.latest_year_start())


def example_monthly_trend(w: Warehouse) -> DataFrame:
    return monthly(w, "sales", {"revenue": "revenue"}).orderBy("yr", "mo").select("period", "revenue")


def example_category_sales(w: Warehouse) -> DataFrame:
    totals = w.totals("sales", ["Category"], {"revenue": "revenue"})
    return totals.select("Category", *_doubles("revenue")).orderBy(F.desc("revenue"), "Category")


# SQL -------------------------------------------------------------------------------------------------


def adhoc_sql(w: Warehouse, query: str, rows: int = QUESTION_ROWS) -> DataFrame:
    """The first rows of one read-only query over the warehouse tables.

    The text is used as a subquery, which is what keeps it read-only: anything but a query does not parse
    there.  It stands on lines of its own, so it may end in a comment.
    """
    for name, table in w.tables_for_sql().items():
        table.createOrReplaceTempView(name)
    return limited_fetch(w.spark.sql(f"SELECT * FROM (\n{query.rstrip().rstrip(';')}\n)"), rows)
