"""Dimensions from the operational tables.

Each function returns the natural key and the attributes.  Whoever stores a dimension adds a surrogate key;
the queries use natural keys, so that results do not depend on key assignment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.functions.calendar import calendar_columns
from starcellar.operators.lookup import DROP, lookup


def dim_date(sources: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per day from the earliest to the latest date in the given columns.

    Each source is read once for all its date columns; what meets in one place is one row per column.
    """
    bounds = []
    for df, columns in sources:
        days = [F.col(c).cast("date") for c in columns]
        bounds.append(
            df.agg(
                F.array_min(F.array(*(F.min(d) for d in days))).alias("first_day"),
                F.array_max(F.array(*(F.max(d) for d in days))).alias("last_day"),
            )
        )
    span = reduce(DataFrame.unionByName, bounds).agg(F.min("first_day").alias("a"), F.max("last_day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.select(*calendar_columns(F.col("day")))


def fixed_calendar(first: str, last: str, spark) -> DataFrame:
    """The calendar between two given days."""
    span = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    return dim_date([(span, ["a", "b"])])


def dim_location(cities: DataFrame, states: DataFrame, countries: DataFrame) -> DataFrame:
    """Cities with their state and country, by city."""
    return (
        cities.join(states, "StateProvinceID").join(countries, "CountryID")
        .select(
            "CityID", F.col("CityName").alias("City"), F.col("StateProvinceName").alias("State"),
            F.col("CountryName").alias("Country"), "Continent",
        )
        .orderBy("CityID")
    )


def dim_customer(customers: DataFrame, categories: DataFrame, groups: DataFrame, locations: DataFrame) -> DataFrame:
    """Customers with category and buying group where known; without a location they drop out."""
    rows = (
        customers.select("CustomerID", "CustomerName", "CustomerCategoryID", "BuyingGroupID", "CityID")
        .join(categories, "CustomerCategoryID", "left")
        .join(groups, "BuyingGroupID", "left")
    )
    found = lookup(rows, locations, {"CityID": "CityID"}, {"LocationKey": "LocationKey"}, DROP, unique=True)
    return found.select(
        "CustomerID", "CustomerName", F.col("CustomerCategoryName").alias("CustomerCategory"),
        F.col("BuyingGroupName").alias("BuyingGroup"), "LocationKey",
    )


def dim_supplier(suppliers: DataFrame, categories: DataFrame, locations: DataFrame) -> DataFrame:
    """Suppliers with their category; without category or location they drop out."""
    rows = suppliers.select("SupplierID", "SupplierName", "SupplierCategoryID", "CityID").join(
        categories, "SupplierCategoryID"
    )
    found = lookup(rows, locations, {"CityID": "CityID"}, {"LocationKey": "LocationKey"}, DROP, unique=True)
    return found.select(
        "SupplierID", "SupplierName", F.col("SupplierCategoryName").alias("SupplierCategory"), "LocationKey"
    )


def dim_product(products: DataFrame, categories: DataFrame, colors: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products with category, and colour and last cost where known."""
    return (
        products.select("ProductID", "ProductName", "CategoryID", "ColorID", "Brand")
        .join(categories, "CategoryID")
        .join(colors, "ColorID", "left")
        .join(inventory.select("ProductID", "LastCostPrice"), "ProductID", "left")
        .select(
            "ProductID", F.col("ProductName").alias("Product"), F.col("CategoryName").alias("Category"),
            F.col("ColorName").alias("Color"), "Brand", "LastCostPrice",
        )
    )


def dim_employee(employees: DataFrame) -> DataFrame:
    return employees.select("EmployeeID", "FullName", "IsSalesperson").orderBy("EmployeeID")


def dim_delivery_method(methods: DataFrame) -> DataFrame:
    return methods.select("DeliveryMethodID", F.col("DeliveryMethodName").alias("DeliveryMethod"))


def dim_transaction_type(types: DataFrame) -> DataFrame:
    return types.select("TransactionTypeID", F.col("TransactionTypeName").alias("TransactionType"))


def dim_payment_method(methods: DataFrame) -> DataFrame:
    return methods.select("PaymentMethodID", F.col("PaymentMethodName").alias("PaymentMethod"))


def with_natural_key(dimension: DataFrame, natural: str, key: str) -> DataFrame:
    """A dimension whose surrogate key is its natural key."""
    return dimension.withColumn(key, F.col(natural))
