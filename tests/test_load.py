"""The load of the star: repeated runs, failures, unknown members, plans, and the stream over a table of files."""

import datetime as dt

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from conftest import as_sets, views_over

from starcellar.operational import Operational
from starcellar.operators import lookup
from starcellar.plans import loads
from starcellar.plans.loads import MARK
from starcellar.plans.star_load import StarLoad

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def expected(tables):
    return as_sets(loads.fact_sales(tables))


def natural(load):
    rows = loads.with_doubles(load.sales_by_natural_keys())
    return as_sets(rows.select(loads.fact_sales(load.source.tables).columns))


def test_a_run_that_dies_before_the_mark_moves_is_repeated(tables, expected, tmp_path):
    load = StarLoad(Operational(tables), str(tmp_path))
    load.load_dimensions()
    load.load_sales(until=MARK)
    assert load.marks.read("FactSales") <= MARK
    load.append_sales(until=MARK + dt.timedelta(90))  # and the mark was not moved
    last = load.load_sales()
    assert natural(load) == expected
    assert load.load_sales() == last and natural(load) == expected


def test_keys_stay_and_members_gone_are_not_current(spark, tables, tmp_path):
    load = StarLoad(Operational(tables), str(tmp_path))
    load.load_dimensions()
    before = {r.CustomerID: r.CustomerKey for r in load.dimension("DimCustomer").collect()}
    fewer = StarLoad(Operational(tables.replaced(customer=tables.read("customer").filter("c_custkey % 4 > 0"))), str(tmp_path))
    fewer.load_dimensions()
    after = {r.CustomerID: r.CustomerKey for r in fewer.dimension("DimCustomer").collect()}
    assert after == {i: k for i, k in before.items() if i % 4}
    with pytest.raises(Exception, match="CustomerKey found no match"):
        fewer.load_sales()


def test_broken_rows_do_not_move_the_mark(tables, tmp_path):
    lines = tables.read("lineitem").withColumn("l_quantity", F.when(F.col("l_partkey") == 7, 0.0).otherwise(F.col("l_quantity")))
    load = StarLoad(Operational(tables.replaced(lineitem=lines)), str(tmp_path))
    load.load_dimensions()
    with pytest.raises(ValueError, match="quantity_positive"):
        load.load_sales()
    assert load.marks.read("FactSales") is None


FACTS = ("fact_sales", "fact_purchases", "fact_inventory_transactions", "fact_financial", "incremental_fact", "dim_customer",
         "dim_product")
SHORT_KEYS = "Employee|DeliveryMethod|TransactionType|PaymentMethod|CategoryID|l_linestatus|l_returnflag|o_orderpriority|o_orderstatus"


@pytest.mark.parametrize("name", FACTS)
def test_no_fact_is_shuffled_by_a_list_key(spark, folder, name):
    """With tables beyond the broadcast threshold, rows are never dealt by a key of a few values."""
    before = {key: spark.conf.get(key, None) for key in THRESHOLDS}
    try:
        for key in THRESHOLDS:
            spark.conf.set(key, "-1")
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not [d for d in dealt if re.search(SHORT_KEYS, d)], dealt


def test_a_long_list_is_refused(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        lookup.short_list(spark.range(4), 3)
    assert lookup.short_list(spark.range(3), 3).count() == 3


@pytest.mark.parametrize("files", [1, 3])
def test_stream_over_a_table_of_files(spark, folder, tmp_path, files):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    line = compare(spark, views_over(str(tmp_path)), str(tmp_path), "stream_fact_sales", entry.queries()["stream_fact_sales"],
                   entry.oracle_sql()["stream_fact_sales"])
    assert line.startswith("same"), line


def test_a_question_may_end_in_a_comment(warehouse):
    from starcellar.plans import adhoc
    assert adhoc.adhoc_sql(warehouse, "SELECT COUNT(*) AS n FROM DimProduct -- all of them").count() == 1
