import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import as_sets, day
from starcellar.operators import clean
from starcellar.operators.constraints import constraint_report, require_valid
from starcellar.schemas import OPERATIONAL, RULES, Rules
from starcellar.sources.files import csv_source, limited_fetch, unreadable


def test_csv_source_reads_declared_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CountryID;CountryName;Continent;Region\n1;Côte;Africa;\n2;\"A;B\";;West\n")
    df = csv_source(spark, str(tmp_path / "c.csv"), OPERATIONAL["Countries"])
    assert df.dtypes[0] == ("CountryID", "int")
    assert as_sets(df) == [(1, "Côte", "Africa", None), (2, "A;B", None, "West")]


def test_csv_source_picks_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    (tmp_path / "c.csv").write_text("Extra;CountryName;CountryID;Continent;Region\nx;X;1;;\ny;Y;one;;\nz;Z;;;\n")
    assert as_sets(csv_source(spark, path, "CountryID INT, CountryName STRING")) == [(1, "X"), (None, "Y"), (None, "Z")]
    assert as_sets(unreadable(spark, path, "CountryID INT, CountryName STRING")) == [("CountryID", 1), ("CountryName", 0)]
    with pytest.raises(ValueError, match="Population"):
        csv_source(spark, path, "CountryID INT, Population LONG")


def test_every_extract_becomes_its_table(spark, tmp_path):
    """A line of each extract, with columns nobody asked for, read, cleaned and conformed to checked columns."""
    texts = {"IntegerType()": "1", "LongType()": "1", "DateType()": "2016-05-31", "BooleanType()": "true",
             "StringType()": "x", "TimestampNTZType()": "2016-05-31 12:00:00", "TimestampType()": "2016-05-31 12:00:00"}
    for table in OPERATIONAL:
        schema = clean.extract_schema(table)
        names = [f.name for f in schema][::-1]
        values = [texts.get(str(schema[n].dataType), "1.50") for n in names]
        (tmp_path / f"{table}.csv").write_text(";".join(["ValidTo", *names]) + "\n" + ";".join(["9999", *values]) + "\n")
        path = str(tmp_path / f"{table}.csv")
        assert sum(r["values"] for r in unreadable(spark, path, schema).collect()) == 0, table
        rows = clean.clean_values(csv_source(spark, path, schema))
        computed = [c for c in clean.CONFORMED[table] if c not in rows.columns]
        got = clean.conform(rows.withColumns({c: F.lit(1) for c in computed}), table)
        assert got.columns == list(clean.CONFORMED[table].values()) and got.count() == 1
        assert set(got.columns) <= set(spark.createDataFrame([], OPERATIONAL[table]).columns), table
    assert set(clean.CONFORMED) == set(OPERATIONAL)


def test_all_declared_schemas_parse(spark):
    for table, ddl in OPERATIONAL.items():
        empty = spark.createDataFrame([], ddl)
        assert set(RULES[table].required) <= set(empty.columns), table
        assert {RULES[table].key} | set(RULES[table].references) <= set(empty.columns), table
    assert len(OPERATIONAL) == 25 and set(RULES) == set(OPERATIONAL)


def test_clean_values(spark):
    rows = [
        ("2016-05-31 23:59:00", math.nan, "NULL", "keep"), ("5/31/2016", 1.5, "", " NA "),
        ("20160531", None, "nan", "x"), ("31-May-2016", 0.0, "N/A", "y"), ("rubbish", 2.0, None, "None"), (None, 3.0, "z", "z"),
    ]
    df = spark.createDataFrame(rows, "InvoiceDate STRING, amount DOUBLE, a STRING, b STRING")
    got = clean.clean_values(df).collect()
    assert [r.InvoiceDate for r in got] == [day("2016-05-31")] * 4 + [None, None]
    assert [r.amount for r in got] == [None, 1.5, None, 0.0, 2.0, 3.0]
    assert [r.a for r in got] == [None, None, None, None, None, "z"]
    assert [r.b for r in got] == ["keep", " NA ", "x", "y", None, "z"]


def test_clean_values_drops_time_of_day(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 5, 31, 23, 59),)], "TransactionOccurredWhen TIMESTAMP_NTZ")
    assert clean.clean_values(df).first()[0] == day("2016-05-31")


def test_conform_renames(spark):
    df = spark.createDataFrame([(7, "Red mug", 3, None, 9)], "StockItemID INT, x STRING, QuantityOnHand INT, "
                               "LastCostPrice DECIMAL(18,2), ReorderLevel INT").withColumn("TargetStockLevel", F.lit(4))
    assert clean.conform(df, "Inventory").columns == [
        "ProductID", "CurrentStock", "ReorderLevel", "TargetStockLevel", "LastCostPrice"
    ]


def test_employee_filter_keeps_employees(spark):
    people = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "PersonID INT, IsEmployee INT")
    assert [r.PersonID for r in clean.employee_filter(people).collect()] == [1]


def test_product_conform_takes_smallest_group_and_keeps_items_without(spark):
    items = spark.createDataFrame([(1,), (2,)], "StockItemID INT")
    groups = spark.createDataFrame([(1, 9), (1, 3), (5, 1)], "StockItemID INT, StockGroupID INT")
    assert as_sets(clean.product_conform(items, groups)) == [(1, 3), (2, None)]


def test_order_line_amounts_without_cost(spark):
    lines = spark.createDataFrame([(1, 2, 5), (9, 1, 4)], "StockItemID INT, Quantity INT, UnitPrice INT")
    costs = spark.createDataFrame([(1, 3)], "StockItemID INT, LastCostPrice INT")
    got = clean.order_line_amounts(lines, costs).select("StockItemID", "LineTotal", "ProfitAmount")
    assert as_sets(got) == [(1, 10, 4), (9, 4, None)]


def test_dedupe_takes_first_by_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k STRING, n INT, v STRING")
    assert as_sets(clean.dedupe(df, ["k"], ["n"])) == [("a", 1, "y"), ("b", 5, "z")]


def test_cast_columns(spark):
    df = spark.createDataFrame([(day("2016-01-05"), 4)], "d DATE, n INT")
    assert clean.cast_columns(df, ["d"], ["n"]).first() == ("2016-01-05", "4")


def test_constraint_report_finds_each_violation(spark):
    parent = spark.createDataFrame([(1, "ok"), (1, "copy"), (None, "no key")], "id INT, name STRING")
    child = spark.createDataFrame(
        [(10, 1, 0, "long text"), (11, 2, 5, None), (12, None, 5, "ok"), (13, 2, -1, "ok")],
        "id INT, parent INT, quantity INT, note STRING",
    )
    rules = {
        "parent": Rules("id", ("name",)),
        "child": Rules("id", ("note",), {"parent": ("parent", "id")}, {"positive": "quantity > 0"}, {"note": 5}),
    }
    report = {(r[0], r[1], r[2]): r[3] for r in constraint_report({"parent": parent, "child": child}, rules).collect()}
    assert report == {
        ("parent", "primary_key", "id"): 3, ("parent", "not_null", "name"): 0, ("child", "primary_key", "id"): 0,
        ("child", "not_null", "note"): 1, ("child", "check", "positive"): 2, ("child", "length", "note"): 1,
        ("child", "foreign_key", "parent"): 2,
    }
    with pytest.raises(ValueError, match="child.parent foreign_key: 2 rows"):
        require_valid({"parent": parent, "child": child}, rules)


def test_limited_fetch(spark):
    assert limited_fetch(spark.range(10).orderBy(F.desc("id")), 3).collect() == [(9,), (8,), (7,)]
    assert limited_fetch(spark.range(0), 3).count() == 0
