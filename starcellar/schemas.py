"""Declared schemas of the operational and the warehouse tables.

Schemas are DDL strings, as ``spark.read.schema`` takes them; nothing is inferred.  What must not be null
is part of the constraint lists below, which ``constraint_report`` checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def _name_list(table_key: str, name: str) -> str:
    return f"{table_key} INT, {name} STRING"


_LINE_AMOUNTS = "UnitPrice DECIMAL(18,2), TaxRate DECIMAL(5,2), LineTotal DECIMAL(18,2), ProfitAmount DECIMAL(18,2)"
_TRANSACTION = (
    "TransactionTypeID INT, PaymentMethodID INT, TransactionDate DATE, NetAmount DECIMAL(18,2), "
    "TaxAmount DECIMAL(18,2), TransactionAmount DECIMAL(18,2), RemainingBalance DECIMAL(18,2)"
)

OPERATIONAL: dict[str, str] = {
    "Countries": "CountryID INT, CountryName STRING, Continent STRING, Region STRING",
    "StateProvinces": "StateProvinceID INT, StateProvinceName STRING, CountryID INT",
    "Cities": "CityID INT, CityName STRING, StateProvinceID INT, Population BIGINT",
    "Employees": "EmployeeID INT, FullName STRING, IsSalesperson BOOLEAN",
    "CustomerCategories": _name_list("CustomerCategoryID", "CustomerCategoryName"),
    "BuyingGroups": _name_list("BuyingGroupID", "BuyingGroupName"),
    "SupplierCategories": _name_list("SupplierCategoryID", "SupplierCategoryName"),
    "Categories": _name_list("CategoryID", "CategoryName"),
    "Colors": _name_list("ColorID", "ColorName"),
    "PaymentMethods": _name_list("PaymentMethodID", "PaymentMethodName"),
    "DeliveryMethods": _name_list("DeliveryMethodID", "DeliveryMethodName"),
    "TransactionTypes": _name_list("TransactionTypeID", "TransactionTypeName"),
    "Customers": (
        "CustomerID INT, CustomerName STRING, CustomerCategoryID INT, BuyingGroupID INT, CityID INT, "
        "DeliveryMethodID INT, PhoneNumber STRING, WebsiteURL STRING, CreditLimit DECIMAL(18,2), "
        "AccountOpenedDate DATE"
    ),
    "Suppliers": (
        "SupplierID INT, SupplierName STRING, SupplierCategoryID INT, CityID INT, DeliveryMethodID INT, "
        "PhoneNumber STRING, WebsiteURL STRING"
    ),
    "Products": (
        "ProductID INT, ProductName STRING, SupplierID INT, CategoryID INT, ColorID INT, Brand STRING, "
        "UnitPrice DECIMAL(18,2), TaxRate DECIMAL(5,2), UnitsPerPackage INT, RetailPrice DECIMAL(18,2)"
    ),
    "Inventory": (
        "ProductID INT, CurrentStock INT, ReorderLevel INT, TargetStockLevel INT, LastCostPrice DECIMAL(18,2)"
    ),
    "Orders": "OrderID INT, CustomerID INT, EmployeeID INT, OrderDate DATE, ExpectedDeliveryDate DATE",
    "OrderDetails": f"OrderDetailID INT, OrderID INT, ProductID INT, Quantity INT, {_LINE_AMOUNTS}",
    "Invoices": (
        "InvoiceID INT, OrderID INT, CustomerID INT, EmployeeID INT, DeliveryMethodID INT, InvoiceDate DATE"
    ),
    "InvoiceDetails": f"InvoiceDetailID INT, InvoiceID INT, ProductID INT, Quantity INT, {_LINE_AMOUNTS}",
    "PurchaseOrders": (
        "PurchaseOrderID INT, SupplierID INT, DeliveryMethodID INT, PurchaseOrderDate DATE, ExpectedDeliveryDate DATE"
    ),
    "PurchaseOrderDetails": (
        "PurchaseOrderDetailID INT, PurchaseOrderID INT, ProductID INT, QuantityOrdered INT, "
        "UnitCostPrice DECIMAL(18,2)"
    ),
    "CustomerTransactions": (
        f"CustomerTransactionID INT, CustomerID INT, InvoiceID INT, {_TRANSACTION}"
    ),
    "SupplierTransactions": (
        f"SupplierTransactionID INT, SupplierID INT, PurchaseOrderID INT, {_TRANSACTION}"
    ),
    "InventoryTransactions": (
        "TransactionID INT, ProductID INT, TransactionTypeID INT, CustomerID INT, SupplierID INT, InvoiceID INT, "
        "PurchaseOrderID INT, Quantity INT, TransactionDate TIMESTAMP_NTZ"
    ),
}

WAREHOUSE: dict[str, str] = {
    "DimDate": (
        "DateKey INT, FullDate DATE, DayNumber INT, DayName STRING, MonthNumber INT, MonthName STRING, "
        "QuarterNumber INT, QuarterName STRING, YearNumber INT, MonthYear STRING, WeekNumber INT, IsWeekend BOOLEAN"
    ),
    "DimProduct": (
        "ProductKey BIGINT, ProductID BIGINT, Product STRING, Category STRING, Color STRING, Brand STRING, "
        "LastCostPrice DECIMAL(18,2)"
    ),
    "DimCustomer": (
        "CustomerKey BIGINT, CustomerID BIGINT, CustomerName STRING, CustomerCategory STRING, BuyingGroup STRING, "
        "LocationKey INT"
    ),
    "DimSupplier": (
        "SupplierKey BIGINT, SupplierID BIGINT, SupplierName STRING, SupplierCategory STRING, LocationKey INT"
    ),
    "DimLocation": (
        "LocationKey INT, CityID INT, City STRING, State STRING, Country STRING, Continent STRING"
    ),
    "LoadLog": "TableName STRING, LastLoadDate DATE",
}


@dataclass(frozen=True)
class Rules:
    """Constraints of one table: key, mandatory columns, references, value checks, text lengths."""

    key: str | tuple[str, ...]
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)


def _named(key: str, name: str) -> Rules:
    return Rules(key, (name,), lengths={name: 100})


_CITY, _DELIVERY = ("Cities", "CityID"), ("DeliveryMethods", "DeliveryMethodID")
_PRODUCT, _CUSTOMER, _SUPPLIER = ("Products", "ProductID"), ("Customers", "CustomerID"), ("Suppliers", "SupplierID")
_INVOICE, _PURCHASE = ("Invoices", "InvoiceID"), ("PurchaseOrders", "PurchaseOrderID")
_TYPE, _PAYMENT = ("TransactionTypes", "TransactionTypeID"), ("PaymentMethods", "PaymentMethodID")
_EMPLOYEE = ("Employees", "EmployeeID")

RULES: dict[str, Rules] = {
    "Countries": Rules("CountryID", ("CountryName",), lengths={"CountryName": 100, "Continent": 100, "Region": 100}),
    "StateProvinces": Rules(
        "StateProvinceID", ("StateProvinceName", "CountryID"), {"CountryID": ("Countries", "CountryID")},
        lengths={"StateProvinceName": 100},
    ),
    "Cities": Rules(
        "CityID", ("CityName", "StateProvinceID"), {"StateProvinceID": ("StateProvinces", "StateProvinceID")},
        lengths={"CityName": 100},
    ),
    "Employees": Rules("EmployeeID", ("FullName", "IsSalesperson"), lengths={"FullName": 100}),
    "CustomerCategories": _named("CustomerCategoryID", "CustomerCategoryName"),
    "BuyingGroups": _named("BuyingGroupID", "BuyingGroupName"),
    "SupplierCategories": _named("SupplierCategoryID", "SupplierCategoryName"),
    "Categories": _named("CategoryID", "CategoryName"),
    "Colors": _named("ColorID", "ColorName"),
    "PaymentMethods": _named("PaymentMethodID", "PaymentMethodName"),
    "DeliveryMethods": _named("DeliveryMethodID", "DeliveryMethodName"),
    "TransactionTypes": _named("TransactionTypeID", "TransactionTypeName"),
    "Customers": Rules(
        "CustomerID", ("CustomerName", "CustomerCategoryID", "CityID"),
        {
            "CustomerCategoryID": ("CustomerCategories", "CustomerCategoryID"),
            "BuyingGroupID": ("BuyingGroups", "BuyingGroupID"),
            "CityID": _CITY,
            "DeliveryMethodID": _DELIVERY,
        },
        lengths={"CustomerName": 100, "PhoneNumber": 30, "WebsiteURL": 200},
    ),
    "Suppliers": Rules(
        "SupplierID", ("SupplierName", "SupplierCategoryID", "CityID"),
        {
            "SupplierCategoryID": ("SupplierCategories", "SupplierCategoryID"),
            "CityID": _CITY,
            "DeliveryMethodID": _DELIVERY,
        },
        lengths={"SupplierName": 100, "PhoneNumber": 30, "WebsiteURL": 200},
    ),
    "Products": Rules(
        "ProductID", ("ProductName", "SupplierID", "CategoryID"),
        {"SupplierID": _SUPPLIER, "CategoryID": ("Categories", "CategoryID"), "ColorID": ("Colors", "ColorID")},
        lengths={"ProductName": 150, "Brand": 100},
    ),
    "Inventory": Rules(
        "ProductID", ("CurrentStock",), {"ProductID": _PRODUCT}, checks={"stock_not_negative": "CurrentStock >= 0"}
    ),
    "Orders": Rules(
        "OrderID", ("CustomerID", "EmployeeID", "OrderDate"), {"CustomerID": _CUSTOMER, "EmployeeID": _EMPLOYEE}
    ),
    "OrderDetails": Rules(
        "OrderDetailID", ("OrderID", "ProductID", "Quantity"),
        {"OrderID": ("Orders", "OrderID"), "ProductID": _PRODUCT}, {"quantity_positive": "Quantity > 0"},
    ),
    "Invoices": Rules(
        "InvoiceID", ("OrderID", "CustomerID", "EmployeeID", "InvoiceDate"),
        {
            "OrderID": ("Orders", "OrderID"),
            "CustomerID": _CUSTOMER,
            "EmployeeID": _EMPLOYEE,
            "DeliveryMethodID": _DELIVERY,
        },
    ),
    "InvoiceDetails": Rules(
        "InvoiceDetailID", ("InvoiceID", "ProductID", "Quantity"),
        {"InvoiceID": _INVOICE, "ProductID": _PRODUCT}, {"quantity_positive": "Quantity > 0"},
    ),
    "PurchaseOrders": Rules(
        "PurchaseOrderID", ("SupplierID", "PurchaseOrderDate"),
        {"SupplierID": _SUPPLIER, "DeliveryMethodID": _DELIVERY},
    ),
    "PurchaseOrderDetails": Rules(
        "PurchaseOrderDetailID", ("PurchaseOrderID", "ProductID", "QuantityOrdered"),
        {"PurchaseOrderID": _PURCHASE, "ProductID": _PRODUCT}, {"quantity_positive": "QuantityOrdered > 0"},
    ),
    "CustomerTransactions": Rules(
        "CustomerTransactionID", ("CustomerID", "TransactionTypeID", "TransactionDate"),
        {"CustomerID": _CUSTOMER, "InvoiceID": _INVOICE, "TransactionTypeID": _TYPE, "PaymentMethodID": _PAYMENT},
    ),
    "SupplierTransactions": Rules(
        "SupplierTransactionID", ("SupplierID", "TransactionTypeID", "TransactionDate"),
        {"SupplierID": _SUPPLIER, "PurchaseOrderID": _PURCHASE, "TransactionTypeID": _TYPE,
         "PaymentMethodID": _PAYMENT},
    ),
    "InventoryTransactions": Rules(
        "TransactionID", ("ProductID", "TransactionTypeID", "Quantity", "TransactionDate"),
        {"ProductID": _PRODUCT, "TransactionTypeID": _TYPE, "CustomerID": _CUSTOMER, "SupplierID": _SUPPLIER,
         "InvoiceID": _INVOICE, "PurchaseOrderID": _PURCHASE},
    ),
}
