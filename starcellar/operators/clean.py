"""Cleaning and conforming of extracts on their way into the operational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcellar.schemas import OPERATIONAL

# The columns that hold dates.
DATE_COLUMNS = (
    "AccountOpenedDate", "OrderDate", "PurchaseOrderDate", "ExpectedDeliveryDate", "InvoiceDate", "TransactionDate",
    "TransactionOccurredWhen",
)
# Texts that stand for a missing value in an extract.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Date formats tried after the ISO forms Spark reads by itself.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "d-MMM-yyyy", "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """The day a text names, NULL where it names none; the time of day is dropped."""
    attempts = [F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMATS)]
    return F.coalesce(*attempts).cast("date")


def clean_values(df: DataFrame, date_columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Missing values to NULL and date columns to dates, as projections over the columns present."""
    cleaned = {}
    for column in df.schema.fields:
        value, kind = F.col(column.name), column.dataType.simpleString()
        if kind == "string":
            value = F.when(~value.isin(*MISSING_TEXTS), value)
            if column.name in date_columns:
                value = parse_date(value)
        elif kind in ("double", "float"):
            value = F.nanvl(value, F.lit(None).cast(kind))
        elif column.name in date_columns:
            value = value.cast("date")
        cleaned[column.name] = value
    return df.withColumns(cleaned)


def project_rename(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Pick columns, renaming those given as ``{old: new}``."""
    pairs = columns.items() if isinstance(columns, Mapping) else ((c, c) for c in columns)
    return df.select(*(F.col(old).alias(new) for old, new in pairs))


# Extract columns and the operational columns they become.
CONFORMED: dict[str, dict[str, str]] = {
    "Countries": {"CountryID": "CountryID", "CountryName": "CountryName", "Continent": "Continent", "Region": "Region"},
    "StateProvinces": {
        "StateProvinceID": "StateProvinceID", "StateProvinceName": "StateProvinceName", "CountryID": "CountryID",
    },
    **{
        table: {f"{entity}{part}": f"{entity}{part}" for part in ("ID", "Name")}
        for table, entity in (
            ("CustomerCategories", "CustomerCategory"), ("BuyingGroups", "BuyingGroup"),
            ("SupplierCategories", "SupplierCategory"), ("Colors", "Color"), ("PaymentMethods", "PaymentMethod"),
            ("DeliveryMethods", "DeliveryMethod"), ("TransactionTypes", "TransactionType"),
        )
    },
    "Cities": {
        "CityID": "CityID", "CityName": "CityName", "StateProvinceID": "StateProvinceID",
        "LatestRecordedPopulation": "Population",
    },
    "Employees": {"PersonID": "EmployeeID", "FullName": "FullName", "IsSalesperson": "IsSalesperson"},
    "Categories": {"StockGroupID": "CategoryID", "StockGroupName": "CategoryName"},
    "Customers": {
        "CustomerID": "CustomerID", "CustomerName": "CustomerName", "CustomerCategoryID": "CustomerCategoryID",
        "BuyingGroupID": "BuyingGroupID", "DeliveryCityID": "CityID", "DeliveryMethodID": "DeliveryMethodID",
        "PhoneNumber": "PhoneNumber", "WebsiteURL": "WebsiteURL", "CreditLimit": "CreditLimit",
        "AccountOpenedDate": "AccountOpenedDate",
    },
    "Suppliers": {
        "SupplierID": "SupplierID", "SupplierName": "SupplierName", "SupplierCategoryID": "SupplierCategoryID",
        "DeliveryCityID": "CityID", "DeliveryMethodID": "DeliveryMethodID", "PhoneNumber": "PhoneNumber",
        "WebsiteURL": "WebsiteURL",
    },
    "Products": {
        "StockItemID": "ProductID", "StockItemName": "ProductName", "SupplierID": "SupplierID",
        "StockGroupID": "CategoryID", "ColorID": "ColorID", "Brand": "Brand", "UnitPrice": "UnitPrice",
        "TaxRate": "TaxRate", "QuantityPerOuter": "UnitsPerPackage", "RecommendedRetailPrice": "RetailPrice",
    },
    "Inventory": {
        "StockItemID": "ProductID", "QuantityOnHand": "CurrentStock", "ReorderLevel": "ReorderLevel",
        "TargetStockLevel": "TargetStockLevel", "LastCostPrice": "LastCostPrice",
    },
    "Orders": {
        "OrderID": "OrderID", "CustomerID": "CustomerID", "SalespersonPersonID": "EmployeeID",
        "OrderDate": "OrderDate", "ExpectedDeliveryDate": "ExpectedDeliveryDate",
    },
    "OrderDetails": {
        "OrderLineID": "OrderDetailID", "OrderID": "OrderID", "StockItemID": "ProductID", "Quantity": "Quantity",
        "UnitPrice": "UnitPrice", "TaxRate": "TaxRate", "LineTotal": "LineTotal", "ProfitAmount": "ProfitAmount",
    },
    "Invoices": {
        "InvoiceID": "InvoiceID", "OrderID": "OrderID", "CustomerID": "CustomerID",
        "SalespersonPersonID": "EmployeeID", "DeliveryMethodID": "DeliveryMethodID", "InvoiceDate": "InvoiceDate",
    },
    "InvoiceDetails": {
        "InvoiceLineID": "InvoiceDetailID", "InvoiceID": "InvoiceID", "StockItemID": "ProductID",
        "Quantity": "Quantity", "UnitPrice": "UnitPrice", "TaxRate": "TaxRate", "ExtendedPrice": "LineTotal",
        "LineProfit": "ProfitAmount",
    },
    "PurchaseOrders": {
        "PurchaseOrderID": "PurchaseOrderID", "SupplierID": "SupplierID", "DeliveryMethodID": "DeliveryMethodID",
        "OrderDate": "PurchaseOrderDate", "ExpectedDeliveryDate": "ExpectedDeliveryDate",
    },
    "PurchaseOrderDetails": {
        "PurchaseOrderLineID": "PurchaseOrderDetailID", "PurchaseOrderID": "PurchaseOrderID",
        "StockItemID": "ProductID", "OrderedOuters": "QuantityOrdered",
        "ExpectedUnitPricePerOuter": "UnitCostPrice",
    },
    "CustomerTransactions": {
        "CustomerTransactionID": "CustomerTransactionID", "CustomerID": "CustomerID", "InvoiceID": "InvoiceID",
        "TransactionTypeID": "TransactionTypeID", "PaymentMethodID": "PaymentMethodID",
        "TransactionDate": "TransactionDate", "AmountExcludingTax": "NetAmount", "TaxAmount": "TaxAmount",
        "TransactionAmount": "TransactionAmount", "OutstandingBalance": "RemainingBalance",
    },
    "SupplierTransactions": {
        "SupplierTransactionID": "SupplierTransactionID", "SupplierID": "SupplierID",
        "PurchaseOrderID": "PurchaseOrderID", "TransactionTypeID": "TransactionTypeID",
        "PaymentMethodID": "PaymentMethodID", "TransactionDate": "TransactionDate",
        "AmountExcludingTax": "NetAmount", "TaxAmount": "TaxAmount", "TransactionAmount": "TransactionAmount",
        "OutstandingBalance": "RemainingBalance",
    },
    "InventoryTransactions": {
        "StockItemTransactionID": "TransactionID", "StockItemID": "ProductID",
        "TransactionTypeID": "TransactionTypeID", "CustomerID": "CustomerID", "SupplierID": "SupplierID",
        "InvoiceID": "InvoiceID", "PurchaseOrderID": "PurchaseOrderID", "Quantity": "Quantity",
        "TransactionOccurredWhen": "TransactionDate",
    },
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """An extract as the operational table of that name."""
    return clean_values(project_rename(df, CONFORMED[table]))


def employee_filter(people: DataFrame) -> DataFrame:
    """People who are employees."""
    return people.filter(F.col("IsEmployee").cast("int") == 1)


def first_category(item_groups: DataFrame, item: str = "StockItemID", group: str = "StockGroupID") -> DataFrame:
    """One group per item, the one with the smallest id; combined map-side, so a large item stays one row."""
    return item_groups.groupBy(item).agg(F.min(group).alias(group))


def product_conform(items: DataFrame, item_groups: DataFrame) -> DataFrame:
    """Items with their first group, kept without one."""
    return items.join(first_category(item_groups), "StockItemID", "left")


def order_line_amounts(lines: DataFrame, costs: DataFrame, key: str = "StockItemID") -> DataFrame:
    """Lines with total and profit; without a known cost the profit is NULL."""
    priced = lines.join(costs.select(key, "LastCostPrice"), key, "left")
    quantity, price = F.col("Quantity"), F.col("UnitPrice")
    return priced.withColumns(
        {"LineTotal": quantity * price, "ProfitAmount": (price - F.col("LastCostPrice")) * quantity}
    )


def cast_columns(df: DataFrame, dates: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Dates to ``yyyy-MM-dd`` texts and other columns to texts, as a text-keyed load expects them."""
    return df.withColumns(
        {**{d: F.date_format(F.col(d), "yyyy-MM-dd") for d in dates}, **{t: F.col(t).cast("string") for t in texts}}
    )


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate rather than a window: every task keeps one row per key, so the copies of a key never
    meet in one place.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)


# Extract columns that are used before a table is conformed, and columns that are computed and in no extract.
BEFORE_CONFORMING = {"Employees": "IsEmployee INT"}
COMPUTED = {"OrderDetails": {"LineTotal", "ProfitAmount"}, "InvoiceDetails": set(), "Products": {"StockGroupID"}}


def extract_schema(table: str) -> T.StructType:
    """The columns an extract is read for, under the extract's names and with the operational table's types."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(OPERATIONAL[table])}
    fields = [
        T.StructField(old, kinds[new]) for old, new in CONFORMED[table].items() if old not in COMPUTED.get(table, set())
    ]
    return T.StructType([*fields, *T.StructType.fromDDL(BEFORE_CONFORMING.get(table, "")).fields])
