"""Queries of the printed reports: details with filters, lists to choose from, and the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.functions.calendar import ATTRIBUTES
from starcellar.functions.money import ratio
from starcellar.operators.ranking import top_n_with_ties
from starcellar.plans.cube import cube_slice, doubles, stock_changes
from starcellar.plans.warehouse import DIMENSIONS, Warehouse

SALES_DETAIL = ("CustomerName", "MonthNumber", "DeliveryMethod", "FullName", "City", "Product", "Category")
PURCHASE_DETAIL = ("SupplierName", "Category", "Product", "DeliveryMethod", "City")
# Cells of the sales report; its month name, quarter and month label follow from year and month.
SALES_CELLS = (
    "Brand", "Category", "City", "Country", "YearNumber", "MonthNumber", "CustomerCategory", "CustomerName", "FullName",
    "Product",
)


def _chosen(**filters: list | None) -> dict[str, list]:
    return {attribute: values for attribute, values in filters.items() if values}


def sales_details(
    w: Warehouse, years: list[int] | None = None, months: list[int] | None = None,
    customer_categories: list[str] | None = None,
) -> DataFrame:
    """Sales cells of the detail report, filtered to lists of years, months and customer categories."""
    measures = {"total_revenue": "revenue", "total_profit": "profit", "sum_unit_price": "unit_price",
                "sum_quantity": "quantity"}
    filters = _chosen(YearNumber=years, MonthNumber=months, CustomerCategory=customer_categories)
    cells = w.slice("sales", list(SALES_DETAIL), measures, {"invoices": "orders"}, filters)
    revenue, profit = F.col("total_revenue"), F.col("total_profit")
    return cells.select(
        *SALES_DETAIL, *doubles(measures),
        ratio(revenue, F.col("invoices")).alias("avg_revenue_per_invoice"),
        ratio(profit, revenue).alias("profit_margin"),
    )


def purchase_details(
    w: Warehouse, years: list[int] | None = None, months: list[int] | None = None,
    supplier_categories: list[str] | None = None,
) -> DataFrame:
    filters = _chosen(YearNumber=years, MonthNumber=months, SupplierCategory=supplier_categories)
    return cube_slice(w, "purchases", PURCHASE_DETAIL,
                      {"total_purchase_cost": "cost_at_order", "sum_unit_cost": "unit_cost"}, filters=filters)


def inventory_details(
    w: Warehouse, years: list[int] | None = None, months: list[int] | None = None,
    categories: list[str] | None = None,
) -> DataFrame:
    filters = _chosen(YearNumber=years, MonthNumber=months, Category=categories)
    return stock_changes(w, ("Product", "TransactionType"), filters=filters)


def filter_values(w: Warehouse, attribute: str, with_all: bool = False) -> DataFrame:
    """Members of an attribute to choose from, optionally with a row for all of them.

    Calendar members come from the calendar, the others from their dimension.
    """
    if attribute in ATTRIBUTES:
        bounds = w.calendar_bounds()
        days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
        source = days.select(ATTRIBUTES[attribute](F.col("day")).alias(attribute))
    else:
        dim = next(name for name, d in DIMENSIONS.items() if attribute in d.attributes)
        source = w.dimension(dim).select(attribute)
    text = F.col(attribute).cast("string")
    if not with_all:
        return source.distinct().select(text.alias("member"))
    members = source.distinct().rollup(attribute).agg(F.grouping_id().alias("summary"))
    return members.select(F.when(F.col("summary") == 1, "All").otherwise(text).alias("member"))


def profit_by_customer_category(w: Warehouse) -> DataFrame:
    return cube_slice(w, "sales", ("CustomerCategory",), {"profit": "profit"})


def top_salesmen(w: Warehouse, n: int = 5) -> DataFrame:
    """Employees by revenue; equal revenues at the cut all stay."""
    return top_n_with_ties(w.totals("sales", ["FullName"], {"revenue": "revenue"}), n, "revenue").select(
        "FullName", *doubles(["revenue"])
    )


def by_month_year(cells: DataFrame, *columns: str, text_order: bool = False) -> DataFrame:
    """Cells by month in calendar order, or with ``text_order`` sorted as labels like the report does."""
    order = ["MonthYear"] if text_order else ["YearNumber", "MonthNumber"]
    return cells.orderBy(*order).select("MonthYear", *columns)


MONTH_CELL = ("YearNumber", "MonthNumber", "MonthYear")


def sales_over_time(w: Warehouse, text_order: bool = False) -> DataFrame:
    cells = cube_slice(w, "sales", MONTH_CELL, {"revenue": "revenue", "profit": "profit"})
    return by_month_year(cells, "revenue", "profit", text_order=text_order)


def margin_by_category(w: Warehouse) -> DataFrame:
    """Margin of each category, and the report's figure, which adds up the margins of its detail cells.

    There are nearly as many cells as rows, so summing by key first would only add a shuffle.
    """
    rows = w.star("sales", [*SALES_CELLS, "LineTotal", "ProfitAmount"])
    cells = rows.groupBy(*SALES_CELLS).agg(F.sum("LineTotal").alias("revenue"), F.sum("ProfitAmount").alias("profit"))
    margin = ratio(F.col("profit"), F.col("revenue"))
    by_category = cells.groupBy("Category").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum(margin).alias("margin_sum")
    )
    return by_category.select(
        "Category", ratio(F.col("profit"), F.col("revenue")).alias("profit_margin"),
        F.round("margin_sum", 4).alias("margin_sum"),
    )


def orders_by_supplier_category(w: Warehouse) -> DataFrame:
    return cube_slice(w, "purchases", ("SupplierCategory",), {"line_count": "lines"})


def top_ordered_products(w: Warehouse, n: int = 5) -> DataFrame:
    """Products by quantity ordered; equal quantities at the cut all stay."""
    return top_n_with_ties(w.totals("purchases", ["Product"], {"quantity": "quantity_ordered"}), n, "quantity")


def purchases_over_time(w: Warehouse, text_order: bool = False) -> DataFrame:
    cells = cube_slice(w, "purchases", MONTH_CELL, {"cost": "cost_at_order", "line_count": "lines"})
    return by_month_year(cells, "cost", "line_count", text_order=text_order)


def cost_by_category(w: Warehouse) -> DataFrame:
    return cube_slice(w, "purchases", ("Category",), {"cost": "cost_at_order"})


def quantities_over_time(w: Warehouse, text_order: bool = False) -> DataFrame:
    cells = stock_changes(w, MONTH_CELL)
    return by_month_year(cells, "qty_in", "qty_out", text_order=text_order)


def purchase_vs_sale(w: Warehouse) -> DataFrame:
    """Distinct purchase orders and distinct invoices among the stock movements.

    Two distinct counts in one statement would copy every row once per count, so each has its own scan of
    its one column.
    """
    purchases = w.distinct_counts("movements", [], {"purchase_orders": "orders"})
    sales = w.distinct_counts("movements", [], {"invoices": "invoices"})
    return purchases.select("purchase_orders", sales.scalar().alias("invoices"))


def category_quantities(w: Warehouse) -> DataFrame:
    """Net, in and out by category, without the unknown one."""
    cells = stock_changes(w, ("Category",), unknown=True)
    return cells.filter(F.lower("Category") != "unknown")


def transactions_over_time(w: Warehouse, text_order: bool = False) -> DataFrame:
    cells = cube_slice(w, "movements", MONTH_CELL, {"transaction_count": "lines"})
    return by_month_year(cells, "transaction_count", text_order=text_order)

