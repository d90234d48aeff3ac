"""Facts from the operational tables: source join, key lookups, and incremental loads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.operators.lookup import DROP, KEEP, lookup

Dimensions = Mapping[str, DataFrame]

# Lookups of several facts: dimension, source column, natural key, key, and what becomes of rows without a match.
PRODUCT = ("DimProduct", "ProductID", "ProductID", "ProductKey", DROP)
DELIVERY = ("DimDeliveryMethod", "DeliveryMethodID", "DeliveryMethodID", "DeliveryMethodKey", DROP)


def _find(df: DataFrame, dims: Dimensions, dim: str, source: str, natural: str, key: str, mode: str,
          alias: str | None = None) -> DataFrame:
    """Look up one key; stored dimensions have one row per natural key."""
    return lookup(df, dims[dim], {source: natural}, {key: alias or key}, mode, unique=True)


def fact_sales(invoices: DataFrame, details: DataFrame, dims: Dimensions) -> DataFrame:
    """Invoice lines with their keys.

    Lines without a known date, product or delivery method drop out; an unknown employee or customer fails
    the load.  A date is looked up as a date, not as text.
    """
    by_line = "DeliveryMethodID" in details.columns
    heads = invoice_keys(invoices, dims)
    heads = heads if by_line else _find(heads, dims, *DELIVERY)
    lines = _find(details, dims, *PRODUCT)
    lines = _find(lines, dims, *DELIVERY) if by_line else lines
    return _sales_columns(lines.join(heads, "InvoiceID"))


def invoice_keys(invoices: DataFrame, dims: Dimensions) -> DataFrame:
    """Invoices with what they alone decide, looked up per invoice, before their lines are joined."""
    heads = _find(invoices.drop("OrderID"), dims, "DimDate", "InvoiceDate", "FullDate", "DateKey", DROP, "InvoiceDateKey")
    heads = _find(heads, dims, "DimEmployee", "EmployeeID", "EmployeeID", "EmployeeKey", KEEP)
    return _find(heads, dims, "DimCustomer", "CustomerID", "CustomerID", "CustomerKey", KEEP)


def sales_of_keyed(lines: DataFrame, dims: Dimensions, also: tuple[str, ...] = ()) -> DataFrame:
    """Invoice lines that carry the keys of their invoice, with their own keys, by the rules of ``fact_sales``."""
    return _sales_columns(_find(_find(lines, dims, *PRODUCT), dims, *DELIVERY), also)


def _sales_columns(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    # An invoice none of whose lines is loaded cannot fail the load, so this is checked on the joined rows.
    return required(rows, ("EmployeeKey", "CustomerKey"), "ProductKey").select(
        "InvoiceDateKey", "ProductKey", "InvoiceID", "CustomerKey", "EmployeeKey", "DeliveryMethodKey", "Quantity",
        "UnitPrice", "TaxRate", "LineTotal", "ProfitAmount", *also,
    )


def sales_of_lines(lines: DataFrame, dims: Dimensions, also: tuple[str, ...] = ()) -> DataFrame:
    """Invoice lines that carry their invoice's columns, with their keys, by the rules of ``fact_sales``."""
    rows = _find(lines, dims, "DimDate", "InvoiceDate", "FullDate", "DateKey", DROP, "InvoiceDateKey")
    rows = _find(_find(rows, dims, *DELIVERY), dims, *PRODUCT)
    rows = _find(rows, dims, "DimEmployee", "EmployeeID", "EmployeeID", "EmployeeKey", KEEP)
    rows = _find(rows, dims, "DimCustomer", "CustomerID", "CustomerID", "CustomerKey", KEEP)
    return _sales_columns(rows, also)


def required(rows: DataFrame, keys: tuple[str, ...], line_column: str) -> DataFrame:
    """Fail on a row without one of the keys.

    The condition also names a column of the line, which keeps Spark from testing it before the join.
    """
    for key in keys:
        broken = F.col(key).isNull() & F.col(line_column).isNotNull()
        message = F.lit(f"{key} found no match")
        rows = rows.filter(F.when(broken, F.raise_error(message)).otherwise(True))
    return rows


def purchase_lines(orders: DataFrame, details: DataFrame, products: DataFrame) -> DataFrame:
    """Purchase order lines with their order's columns and the tax rate of the product."""
    return details.join(orders, "PurchaseOrderID").join(products.select("ProductID", "TaxRate"), "ProductID")


def fact_purchases(lines: DataFrame, dims: Dimensions, also: tuple[str, ...] = ()) -> DataFrame:
    """Purchase order lines with their keys; every lookup drops lines it cannot resolve.  ``also``: columns carried along.

    The calendar ends with the last order, so lines expected after it vanish, as they do in the source system.
    """
    rows = _find(lines, dims, "DimDate", "PurchaseOrderDate", "FullDate", "DateKey", DROP, "PurchaseDateKey")
    rows = _find(rows, dims, "DimDate", "ExpectedDeliveryDate", "FullDate", "DateKey", DROP, "ExpectedDeliveryDateKey")
    rows = _find(rows, dims, "DimProduct", "ProductID", "ProductID", "ProductKey", DROP)
    rows = _find(rows, dims, "DimSupplier", "SupplierID", "SupplierID", "SupplierKey", DROP)
    rows = _find(rows, dims, "DimDeliveryMethod", "DeliveryMethodID", "DeliveryMethodID", "DeliveryMethodKey", DROP)
    return rows.select(
        "PurchaseDateKey", "ExpectedDeliveryDateKey", "PurchaseOrderID", "ProductKey", "SupplierKey",
        "DeliveryMethodKey", "QuantityOrdered", "UnitCostPrice", "TaxRate", *also,
    )


def fact_inventory(inventory: DataFrame, dims: Dimensions) -> DataFrame:
    """The stock snapshot with product keys."""
    rows = _find(inventory, dims, "DimProduct", "ProductID", "ProductID", "ProductKey", DROP)
    return rows.select("ProductKey", "CurrentStock", "ReorderLevel", "TargetStockLevel", "LastCostPrice")


def fact_inventory_transactions(transactions: DataFrame, dims: Dimensions) -> DataFrame:
    """Stock movements by day; movements without a known day, product or type drop out."""
    rows = transactions.withColumn("TransactionDay", F.col("TransactionDate").cast("date"))
    rows = _find(rows, dims, "DimDate", "TransactionDay", "FullDate", "DateKey", DROP)
    rows = _find(rows, dims, "DimProduct", "ProductID", "ProductID", "ProductKey", DROP)
    rows = _find(rows, dims, "DimTransactionType", "TransactionTypeID", "TransactionTypeID", "TransactionTypeKey", DROP)
    return rows.select("DateKey", "ProductKey", "TransactionTypeKey", "InvoiceID", "PurchaseOrderID", "Quantity")


def fact_financial(customer_side: DataFrame, supplier_side: DataFrame, dims: Dimensions, also: tuple[str, ...] = ()) -> DataFrame:
    """Customer and supplier transactions in one fact, tagged with their source; unknown keys stay NULL.  ``also``: columns
    carried along.

    Each side is looked up in its own dimension before the union: after it, one side of the rows would carry
    a NULL key into each of the two joins.
    """
    paid_in = _find(customer_side, dims, "DimCustomer", "CustomerID", "CustomerID", "CustomerKey", KEEP)
    paid_out = _find(supplier_side, dims, "DimSupplier", "SupplierID", "SupplierID", "SupplierKey", KEEP)
    rows = paid_in.drop("CustomerID").withColumn("TransactionSource", F.lit("Customer")).unionByName(
        paid_out.drop("SupplierID").withColumn("TransactionSource", F.lit("Supplier")), allowMissingColumns=True
    )
    rows = _find(rows, dims, "DimDate", "TransactionDate", "FullDate", "DateKey", KEEP)
    rows = _find(rows, dims, "DimPaymentMethod", "PaymentMethodID", "PaymentMethodID", "PaymentMethodKey", KEEP)
    rows = _find(rows, dims, "DimTransactionType", "TransactionTypeID", "TransactionTypeID", "TransactionTypeKey", KEEP)
    return rows.select(
        "DateKey", "CustomerKey", "SupplierKey", "InvoiceID", "PurchaseOrderID", "PaymentMethodKey",
        "TransactionTypeKey", "TransactionSource", "NetAmount", "TaxAmount", "TransactionAmount", "RemainingBalance", *also,
    )


def newer_rows(source: DataFrame, date: str, mark: dt.date | None) -> DataFrame:
    """Source rows dated strictly after the mark; all of them before the first load."""
    return source if mark is None else source.filter(F.col(date) > F.lit(mark))


def late_rows(
    source: DataFrame, date: str, mark: dt.date | None, lookback_days: int, loaded: DataFrame, key: str
) -> DataFrame:
    """Rows of the days up to the mark that were not loaded with them.

    ``loaded`` holds the fact's ``key`` for those days only, so the anti join reads a few days of the fact.
    """
    if mark is None or lookback_days <= 0:
        return source.limit(0)
    window = source.filter(
        (F.col(date) <= F.lit(mark)) & (F.col(date) > F.date_sub(F.lit(mark), lookback_days))
    )
    return window.join(loaded.select(key).distinct(), key, "left_anti")
