"""Calendar, dimensions, lookups, facts and keys on hand-written rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import as_sets, day
from starcellar.functions import calendar
from starcellar.functions.money import margin_label, margin_percent, money_label, ratio, ratio_or_zero, rounded
from starcellar.operators import dimensions, facts
from starcellar.operators.keys import fact_key, surrogate_key
from starcellar.operators.lookup import DROP, FAIL, KEEP, lookup
from starcellar.operators.ranking import top_n, top_n_per_group, top_n_with_ties


def test_calendar_attributes(spark):
    df = spark.createDataFrame([(day("2016-01-01"),), (day("2016-01-03"),), (day("2016-12-31"),)], "d DATE")
    got = df.select(*calendar.calendar_columns(F.col("d"))).collect()
    assert got[0].asDict() == {
        "DateKey": 20160101, "FullDate": day("2016-01-01"), "DayNumber": 1, "DayName": "Friday", "MonthNumber": 1,
        "MonthName": "January", "QuarterNumber": 1, "QuarterName": "Q1", "YearNumber": 2016,
        "MonthYear": "2016-Jan", "WeekNumber": 1, "IsWeekend": True,
    }
    assert (got[1].DayName, got[1].WeekNumber, got[1].IsWeekend) == ("Sunday", 2, False)
    assert (got[2].DayName, got[2].WeekNumber, got[2].IsWeekend) == ("Saturday", 53, True)


def test_week_number_against_counting(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2012-01-01', DATE'2023-12-31')) AS d")
    for d, week in days.select("d", calendar.week_number(F.col("d"))).collect():
        first = dt.date(d.year, 1, 1)
        sundays = sum((first + dt.timedelta(i)).weekday() == 6 for i in range(1, (d - first).days + 1))
        assert week == 1 + sundays, d


def test_periods():
    assert calendar.month_range(2016, 12) == (day("2016-12-01"), day("2017-01-01"))
    assert calendar.previous_month(day("2016-01-31")) == (2015, 12)


def test_dim_date_spans_all_columns(spark):
    a = spark.createDataFrame([(day("2016-01-03"), None), (day("2016-01-02"), None)], "x DATE, y DATE")
    b = spark.createDataFrame([(dt.datetime(2016, 1, 6, 12),)], "t TIMESTAMP_NTZ")
    days = dimensions.dim_date([(a, ["x", "y"]), (b, ["t"])])
    assert [r.FullDate.day for r in days.orderBy("FullDate").collect()] == [2, 3, 4, 5, 6]


def test_dim_date_of_nothing_is_empty(spark):
    empty = spark.createDataFrame([], "x DATE")
    assert dimensions.dim_date([(empty, ["x"])]).count() == 0


def test_fixed_calendar(spark):
    assert dimensions.fixed_calendar("2013-01-01", "2016-12-31", spark).count() == 1461


def test_dim_customer_joins(spark):
    customers = spark.createDataFrame(
        [(1, "A", 1, 1, 10), (2, "B", 9, None, 10), (3, "C", 1, None, 99)],
        "CustomerID INT, CustomerName STRING, CustomerCategoryID INT, BuyingGroupID INT, CityID INT",
    )
    categories = spark.createDataFrame([(1, "Shop")], "CustomerCategoryID INT, CustomerCategoryName STRING")
    groups = spark.createDataFrame([(1, "G")], "BuyingGroupID INT, BuyingGroupName STRING")
    locations = spark.createDataFrame([(10, 5)], "CityID INT, LocationKey INT")
    got = dimensions.dim_customer(customers, categories, groups, locations)
    assert as_sets(got) == [(1, "A", "Shop", "G", 5), (2, "B", None, None, 5)]


def test_dim_supplier_and_product_joins(spark):
    suppliers = spark.createDataFrame(
        [(1, "A", 1, 10), (2, "B", 9, 10), (3, "C", 1, 99)],
        "SupplierID INT, SupplierName STRING, SupplierCategoryID INT, CityID INT",
    )
    categories = spark.createDataFrame([(1, "Toys")], "SupplierCategoryID INT, SupplierCategoryName STRING")
    locations = spark.createDataFrame([(10, 5)], "CityID INT, LocationKey INT")
    assert as_sets(dimensions.dim_supplier(suppliers, categories, locations)) == [(1, "A", "Toys", 5)]
    products = spark.createDataFrame(
        [(1, "Mug", 1, 1, "X"), (2, "Cup", 1, None, None), (3, "Pot", 9, 1, "X")],
        "ProductID INT, ProductName STRING, CategoryID INT, ColorID INT, Brand STRING",
    )
    groups = spark.createDataFrame([(1, "Ware")], "CategoryID INT, CategoryName STRING")
    colors = spark.createDataFrame([(1, "Red")], "ColorID INT, ColorName STRING")
    stock = spark.createDataFrame([(1, Decimal("2.50"))], "ProductID INT, LastCostPrice DECIMAL(18,2)")
    assert as_sets(dimensions.dim_product(products, groups, colors, stock)) == [
        (1, "Mug", "Ware", "Red", "X", Decimal("2.50")), (2, "Cup", "Ware", None, None, None)
    ]


def test_dim_payment_method(spark):
    methods = spark.createDataFrame([(1, "Cash")], "PaymentMethodID INT, PaymentMethodName STRING")
    assert dimensions.dim_payment_method(methods).columns == ["PaymentMethodID", "PaymentMethod"]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1), (None, "n", 1)], "id INT, name STRING, seen INT")


def test_lookup_modes(spark, reference):
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k INT")
    take = {"name": "found"}
    assert as_sets(lookup(rows, reference, {"k": "id"}, take, DROP)) == [(1, "a"), (2, "c")]
    assert as_sets(lookup(rows, reference, {"k": "id"}, take, KEEP)) == [(1, "a"), (2, "c"), (3, None), (None, None)]
    assert as_sets(lookup(rows, reference, {"k": "id"}, take, DROP, first_by="seen")) == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="lookup of k found no match"):
        lookup(rows, reference, {"k": "id"}, take, FAIL).collect()
    known = rows.filter("k IN (1, 2)")
    assert lookup(known, reference, {"k": "id"}, take, FAIL).count() == 2


def test_lookup_fails_even_if_only_counted(spark, reference):
    rows = spark.createDataFrame([(3,)], "k INT")
    with pytest.raises(Exception, match="found no match"):
        lookup(rows, reference, {"k": "id"}, {"name": "found"}, FAIL).count()


def test_lookup_on_two_columns_under_the_same_name(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y")], "a INT, b STRING")
    ref = spark.createDataFrame([(1, "x", 7)], "a INT, b STRING, key INT")
    assert as_sets(lookup(rows, ref, {"a": "a", "b": "b"}, {"key": "key"}, KEEP)) == [(1, "x", 7), (1, "y", None)]


@pytest.fixture(scope="module")
def dims(spark):
    def table(ddl, *rows):
        return spark.createDataFrame(list(rows), ddl)

    return {
        "DimDate": table("FullDate DATE, DateKey INT", (day("2016-01-01"), 20160101), (day("2016-01-02"), 20160102)),
        "DimProduct": table("ProductID INT, ProductKey INT", (1, 101), (2, 102)),
        "DimCustomer": table("CustomerID INT, CustomerKey INT", (1, 201)),
        "DimSupplier": table("SupplierID INT, SupplierKey INT", (1, 301)),
        "DimEmployee": table("EmployeeID INT, EmployeeKey INT", (1, 401)),
        "DimDeliveryMethod": table("DeliveryMethodID INT, DeliveryMethodKey INT", (1, 501)),
        "DimTransactionType": table("TransactionTypeID INT, TransactionTypeKey INT", (1, 601)),
        "DimPaymentMethod": table("PaymentMethodID INT, PaymentMethodKey INT", (1, 701)),
    }


INVOICE = "InvoiceID INT, InvoiceDate DATE, CustomerID INT, EmployeeID INT, DeliveryMethodID INT"
DETAIL = "InvoiceID INT, ProductID INT, Quantity INT, UnitPrice INT, TaxRate INT, LineTotal INT, ProfitAmount INT"


def test_fact_sales_drops_and_fails(spark, dims):
    first, late = day("2016-01-01"), day("2017-01-01")
    invoices = spark.createDataFrame(
        [(1, first, 1, 1, 1), (2, late, 1, 1, 1), (3, first, 1, 1, None), (4, first, 9, 9, 1)], INVOICE
    )
    details = spark.createDataFrame(
        [(1, 1, 2, 5, 1, 10, 3), (1, 9, 1, 5, 1, 5, 1), (2, 1, 1, 5, 1, 5, 1), (3, 1, 1, 5, 1, 5, 1),
         (4, 9, 1, 5, 1, 5, 1)], DETAIL,
    )
    # Invoice 4 has an unknown customer, but its only line drops out with its product.
    got = facts.fact_sales(invoices, details, dims)
    assert as_sets(got) == [(20160101, 101, 1, 201, 401, 501, 2, 5, 1, 10, 3)]
    bad = details.unionByName(spark.createDataFrame([(4, 1, 1, 5, 1, 5, 1)], DETAIL))
    with pytest.raises(Exception, match="Key found no match"):
        facts.fact_sales(invoices, bad, dims).collect()


def test_fact_purchases_drops_lines_expected_after_the_calendar(spark, dims):
    lines = spark.createDataFrame(
        [(1, day("2016-01-01"), day("2016-01-02"), 1, 1, 1, 5, 2, 15), (2, day("2016-01-01"), day("2016-01-03"), 1, 1, 1, 5, 2, 15),
         (3, day("2016-01-01"), None, 1, 1, 1, 5, 2, 15), (4, day("2016-01-01"), day("2016-01-02"), 1, 1, 9, 5, 2, 15)],
        "PurchaseOrderID INT, PurchaseOrderDate DATE, ExpectedDeliveryDate DATE, SupplierID INT, DeliveryMethodID INT, "
        "ProductID INT, QuantityOrdered INT, UnitCostPrice INT, TaxRate INT",
    )
    assert as_sets(facts.fact_purchases(lines, dims)) == [(20160101, 20160102, 1, 101, 301, 501, 5, 2, 15)]


def test_purchase_lines(spark):
    orders = spark.createDataFrame([(1, 7)], "PurchaseOrderID INT, SupplierID INT")
    details = spark.createDataFrame([(1, 5, 3), (2, 5, 3)], "PurchaseOrderID INT, ProductID INT, QuantityOrdered INT")
    products = spark.createDataFrame([(5, 15)], "ProductID INT, TaxRate INT")
    assert facts.purchase_lines(orders, details, products).select("SupplierID", "TaxRate").collect() == [(7, 15)]


def test_fact_financial_keeps_unknown_keys(spark, dims):
    amounts = "TransactionTypeID INT, PaymentMethodID INT, TransactionDate DATE, NetAmount INT, TaxAmount INT, " \
              "TransactionAmount INT, RemainingBalance INT"
    ours = spark.createDataFrame([(9, 5, 1, None, day("2016-01-01"), 1, 0, 1, 0)], f"CustomerID INT, InvoiceID INT, {amounts}")
    theirs = spark.createDataFrame([(1, 6, 9, 1, day("2019-01-01"), 2, 0, 2, 0)],
                                   f"SupplierID INT, PurchaseOrderID INT, {amounts}")
    assert as_sets(facts.fact_financial(ours, theirs, dims)) == [
        (20160101, None, None, 5, None, None, 601, "Customer", 1, 0, 1, 0),
        (None, None, 301, None, 6, 701, None, "Supplier", 2, 0, 2, 0),
    ]


def test_fact_inventory_transactions_uses_the_day(spark, dims):
    rows = spark.createDataFrame(
        [(1, 1, dt.datetime(2016, 1, 1, 23), 5, None, -3), (1, 9, dt.datetime(2016, 1, 1, 0), 5, None, 1)],
        "ProductID INT, TransactionTypeID INT, TransactionDate TIMESTAMP_NTZ, InvoiceID INT, PurchaseOrderID INT, Quantity INT",
    )
    assert as_sets(facts.fact_inventory_transactions(rows, dims)) == [(20160101, 101, 601, 5, None, -3)]


def test_surrogate_keys_are_dense_and_stable(spark):
    members = spark.range(1000).select((F.col("id") * 7 + 3).alias("n"))
    keys = surrogate_key(members, "n", "k", buckets=16)
    assert sorted(r.k for r in keys.collect()) == list(range(1, 1001))
    again = surrogate_key(members.repartition(7), "n", "k", buckets=16)
    assert as_sets(keys) == as_sets(again)
    more = members.unionByName(spark.createDataFrame([(-1,), (-2,), (None,)], "n BIGINT"))
    both = {r.n: r.k for r in surrogate_key(more, "n", "k", assigned=keys, buckets=16).collect()}
    assert all(both[r.n] == r.k for r in keys.collect())
    assert {both[-1], both[-2]} == {1001, 1002} and len(both) == 1002


def test_fact_key_depends_on_all_columns(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2)], "a INT, b INT").select(fact_key("a", "b"))
    assert df.distinct().count() == 2


def test_rankings(spark):
    df = spark.createDataFrame([("g", "b", 5), ("g", "a", 5), ("g", "c", 1), ("h", "d", 4)], "g STRING, n STRING, v INT")
    assert [r.n for r in top_n(df, 1, "v", "n").collect()] == ["a"]
    assert [r.n for r in top_n(df, 1, "v", "n", ascending=True).collect()] == ["c"]
    assert sorted(r.n for r in top_n_with_ties(df, 1, "v").collect()) == ["a", "b"]
    assert sorted(r.n for r in top_n_with_ties(df, 3, "v").collect()) == ["a", "b", "d"]
    got = top_n_per_group(df, ["g"], 1, "v", "n").select("g", "n", "position")
    assert as_sets(got) == [("g", "a", 1), ("h", "d", 1)]
    assert top_n_with_ties(df.limit(0), 3, "v").count() == 0


def test_money(spark):
    rows = [(2450000.0, "$2.5M"), (1150.0, "$1.1K"), (1250.0, "$1.2K"), (2.675, "$2.67"), (0.125, "$0.12"), (0.375, "$0.38"),
            (1250000.0, "$1.2M"), (-5.0, "$-5.00"), (999.994, "$999.99"), (3400.0, "$3.4K"), (None, "N/A"), (0.0, "$0.00")]
    df = spark.createDataFrame(rows, "v DOUBLE, want STRING")
    assert all(r[0] == r[1] for r in df.select(money_label(F.col("v")), "want").collect())
    pairs = spark.createDataFrame(
        [(Decimal(245), Decimal(10000)), (Decimal(1), Decimal(8)), (Decimal(0), Decimal(8)), (Decimal(1), Decimal(0)), (None, None)],
        "p DECIMAL(18,2), s DECIMAL(18,2)",
    )
    p, s = F.col("p"), F.col("s")
    assert [r[0] for r in pairs.select(margin_percent(p, s)).collect()] == [2.5, 12.5, None, None, None]
    assert [r[0] for r in pairs.select(margin_label(p, s)).collect()] == ["2.5%", "12.5%", "N/A", "N/A", "N/A"]
    assert [r[0] for r in pairs.select(ratio(p, s)).collect()] == [0.0245, 0.125, 0.0, None, None]
    assert [r[0] for r in pairs.select(ratio_or_zero(p, s)).collect()] == [0.0245, 0.125, 0.0, 0.0, None]


def test_rounding_is_that_of_the_exact_value(spark):
    draw = random.Random(4)
    values = [draw.choice([1, 10, 1e3, 1e6, 1e9]) * draw.random() for _ in range(500)]
    values += [k / 8 for k in range(-40, 40)] + [k + 0.05 for k in range(300)] + [k + 0.005 for k in range(300)] + [0.0, 1e17, 123456789012.345]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (1, 2):
        got = [r[0] for r in df.select(rounded(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
