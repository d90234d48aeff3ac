"""Measures of the four cubes, slices by any attributes, and subtotals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.functions.money import as_double, ratio
from starcellar.plans.warehouse import DIMENSIONS, Warehouse, unique

UNKNOWN = "Unknown"

SALES_SUMS = {
    "sum_invoice_id": "invoice_ids", "sum_quantity": "quantity", "sum_unit_price": "unit_price",
    "sum_tax_rate": "tax_rate", "sum_line_total": "revenue", "sum_profit": "profit", "line_count": "lines",
}
PURCHASE_SUMS = {
    "sum_purchase_order_id": "purchase_order_ids", "sum_quantity_ordered": "quantity_ordered",
    "sum_unit_cost": "unit_cost", "line_count": "lines", "total_purchase_cost": "cost_at_order",
}
MOVEMENT_SUMS = {
    "sum_invoice_id": "invoice_ids", "sum_purchase_order_id": "purchase_order_ids", "sum_quantity": "quantity",
    "transaction_count": "lines",
}
PAYMENT_SUMS = {
    "sum_invoice_id": "invoice_ids", "sum_purchase_order_id": "purchase_order_ids", "sum_net": "net", "sum_tax": "tax",
    "sum_amount": "amount", "sum_balance": "balance", "transaction_count": "lines",
}
WHOLE_NUMBERS = {"sum_quantity", "sum_quantity_ordered", "line_count", "transaction_count", "invoice_count"}


def doubles(names) -> list[Column]:
    """Sums of money as doubles, whole numbers as they are."""
    return [F.col(n) if n in WHOLE_NUMBERS else as_double(F.col(n)).alias(n) for n in names]


def sales_measures(w: Warehouse, by: Sequence[str] = ("YearNumber", "Category"), **options) -> DataFrame:
    """All measures of the sales cube.  Total revenue and profit are the sums under their calculated names."""
    cells = w.slice("sales", list(by), SALES_SUMS, {"invoice_count": "orders"}, **options)
    return cells.select(
        *by, *doubles(SALES_SUMS),
        as_double(F.col("sum_line_total")).alias("total_revenue"),
        as_double(F.col("sum_profit")).alias("total_profit"),
        "invoice_count",
    )


def purchase_measures(w: Warehouse, by: Sequence[str] = ("YearNumber", "SupplierCategory"), **options) -> DataFrame:
    return w.slice("purchases", list(by), PURCHASE_SUMS, **options).select(*by, *doubles(PURCHASE_SUMS))


def inventory_measures(w: Warehouse, by: Sequence[str] = ("YearNumber", "TransactionType"), **options) -> DataFrame:
    return w.slice("movements", list(by), MOVEMENT_SUMS, **options).select(*by, *doubles(MOVEMENT_SUMS))


def financial_measures(
    w: Warehouse, by: Sequence[str] = ("TransactionSource", "TransactionType"), **options
) -> DataFrame:
    return w.slice("payments", list(by), PAYMENT_SUMS, **options).select(*by, *doubles(PAYMENT_SUMS))


def profit_margin(w: Warehouse, by: Sequence[str] = ("Category",), **options) -> DataFrame:
    """Profit by revenue of each cell, from the cell's sums; NULL without revenue."""
    cells = w.slice("sales", list(by), {"revenue": "revenue", "profit": "profit"}, **options)
    return cells.select(*by, ratio(F.col("profit"), F.col("revenue")).alias("profit_margin"))


def avg_revenue_per_invoice(w: Warehouse, by: Sequence[str] = ("YearNumber",), **options) -> DataFrame:
    cells = w.slice("sales", list(by), {"revenue": "revenue"}, {"invoices": "orders"}, **options)
    return cells.select(*by, ratio(F.col("revenue"), F.col("invoices")).alias("avg_revenue_per_invoice"))


def stock_changes(w: Warehouse, by: Sequence[str], per: str = "product", **options) -> DataFrame:
    """Quantity in, out and net by cell.

    With ``per="product"`` each product's movements are netted within the cell before they count as in or
    out, as the cube's measures do, so the result cannot be summed to coarser cells.  With ``per="row"``
    each movement counts by its own sign.
    """
    if per == "product":
        netted = w.slice("movements", unique([*by, "ProductKey"]), {"quantity": "quantity"}, **options)
    else:
        filters = options.get("filters") or {}
        netted = w.star("movements", unique([*by, *filters, "Quantity"])).withColumnRenamed("Quantity", "quantity")
        for attribute, values in filters.items():
            netted = netted.filter(F.col(attribute).isin(values))
    quantity = F.col("quantity")
    cells = netted.groupBy(*by).agg(
        F.sum(F.when(quantity > 0, quantity)).alias("qty_in"),
        F.sum(F.when(quantity < 0, -quantity)).alias("qty_out"),
        F.sum(quantity).alias("net"),
    )
    return cells.select(
        *by,
        F.coalesce("qty_in", F.lit(0)).cast("bigint").alias("qty_in"),
        F.coalesce("qty_out", F.lit(0)).cast("bigint").alias("qty_out"),
        F.col("net").cast("bigint").alias("net_stock_change"),
    )


def receivables(w: Warehouse, by: Sequence[str] = ("TransactionType",), **options) -> DataFrame:
    """Amounts of transactions with customers."""
    cells = w.slice("payments", list(by), {"receivables": "receivables"}, **options)
    return cells.select(*by, *doubles(["receivables"]))


def payables(w: Warehouse, by: Sequence[str] = ("TransactionType",), **options) -> DataFrame:
    """Amounts of transactions with suppliers."""
    cells = w.slice("payments", list(by), {"payables": "payables"}, **options)
    return cells.select(*by, *doubles(["payables"]))


def cube_slice(
    w: Warehouse, fact: str, by: Sequence[str], measures: dict[str, str], counts: dict[str, str] | None = None,
    filters: dict[str, list] | None = None, unknown: bool = False,
) -> DataFrame:
    """Any measures by any attributes, attributes filtered to lists of values."""
    cells = w.slice(fact, list(by), measures, counts, filters, unknown=unknown)
    return cells.select(*by, *doubles(measures), *(counts or {}))


def cube_totals(
    w: Warehouse, fact: str, by: Sequence[str], measures: dict[str, str], how: str = "cube",
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Cells and their subtotals; ``level`` is the grouping id, 0 for a cell, all bits set for the total.

    Only additive measures: the cells are summed first, and the subtotals are built from the cells, so the
    rows are not multiplied by the number of groupings.
    """
    columns = [F.col(b) for b in by]
    cells = w.totals(fact, list(by), measures)
    if how == "sets":
        grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets or [by, []]], *columns)
    else:
        grouped = cells.cube(*columns) if how == "cube" else cells.rollup(*columns)
    summed = grouped.agg(
        *(F.sum(m).alias(m) for m in measures), F.grouping_id().cast("bigint").alias("level")
    )
    return summed.select(*by, "level", *doubles(measures))


def sales_cube(w: Warehouse) -> DataFrame:
    return cube_totals(w, "sales", ("YearNumber", "Category", "CustomerCategory"),
                       {"revenue": "revenue", "profit": "profit", "sum_quantity": "quantity"})


def sales_rollup(w: Warehouse) -> DataFrame:
    """Year, quarter and month subtotals."""
    return cube_totals(w, "sales", ("YearNumber", "QuarterName", "MonthNumber"), {"revenue": "revenue"}, "rollup")


def purchase_sets(w: Warehouse) -> DataFrame:
    """Cost by category, by supplier category, and in total."""
    return cube_totals(w, "purchases", ("Category", "SupplierCategory"), {"cost": "cost_at_order"}, "sets",
                       [["Category"], ["SupplierCategory"], []])


def role_dates(w: Warehouse) -> DataFrame:
    """Purchases by month of order and month of expected delivery: one calendar in two roles."""
    return cube_slice(w, "purchases", ("MonthYear", "ExpectedMonthYear"),
                      {"cost": "cost_at_order", "line_count": "lines"})


def reference_dims(w: Warehouse) -> DataFrame:
    """Amounts by country of the customer and of the supplier: one location dimension in two roles.

    Summed by customer and supplier first; a transaction has one of the two, the other is unknown.
    """
    return cube_slice(w, "payments", ("CustomerCountry", "SupplierCountry"),
                      {"amount": "amount", "transaction_count": "lines"}, unknown=True)


def sales_by_salesperson(w: Warehouse) -> DataFrame:
    """Revenue and invoices by whether the employee sells, and by delivery method."""
    return cube_slice(w, "sales", ("IsSalesperson", "DeliveryMethod"), {"revenue": "revenue", "line_count": "lines"})


def payments_by_method(w: Warehouse) -> DataFrame:
    """Amounts by payment method, transaction type and the customer's country, unknown where there is none."""
    return cube_slice(w, "payments", ("PaymentMethod", "TransactionType", "CustomerCountry"),
                      {"amount": "amount", "balance": "balance"}, unknown=True)


def degenerate_dim(w: Warehouse) -> DataFrame:
    """Transactions by their source, an attribute of the fact itself."""
    return cube_slice(w, "payments", ("TransactionSource",), {"amount": "amount", "transaction_count": "lines"})


def unknown_member(w: Warehouse) -> DataFrame:
    """Amounts by category of the customer and of the supplier, with the missing side shown as unknown."""
    return cube_slice(w, "payments", ("CustomerCategory", "SupplierCategory"), {"amount": "amount"}, unknown=True)


def sales_by_place_and_time(w: Warehouse, years: list[int], categories: list[str]) -> DataFrame:
    """The shared sales data set of the reports, for some years and categories."""
    cells = cube_slice(
        w, "sales", ("Brand", "Category", "Country", "QuarterName", "YearNumber"),
        {"revenue": "revenue", "profit": "profit"}, {"invoice_count": "orders"},
        {"YearNumber": years, "Category": categories},
    )
    return cells.withColumns(
        {
            "profit_margin": ratio(F.col("profit"), F.col("revenue")),
            "avg_revenue_per_invoice": ratio(F.col("revenue"), F.col("invoice_count")),
        }
    )


def purchases_by_place(w: Warehouse) -> DataFrame:
    """The shared purchase data set of the reports."""
    return cube_slice(
        w, "purchases", ("City", "Country", "Brand", "Category", "SupplierName", "SupplierCategory"),
        {"line_count": "lines", "sum_quantity_ordered": "quantity_ordered", "total_purchase_cost": "cost_at_order"},
    )
