"""Star queries: invariants, missing and skewed keys, the stored warehouse, plans, forecasts and the stream."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from conftest import as_sets, day, views_over
from starcellar.layout import Tables
from starcellar.operational import Operational
from starcellar.operators import facts
from starcellar.operators.resolve import resolve
from starcellar.plans import adhoc, cube, dashboard, forecasting, loads, monthly, reports
from starcellar.plans.layout_warehouse import LayoutWarehouse
from starcellar.plans.stored_warehouse import StoredWarehouse, store_warehouse
from starcellar.session import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


# Invariants ------------------------------------------------------------------------------------------


def test_cube_total_is_the_ungrouped_total(warehouse):
    total = cube.sales_cube(warehouse).filter("level = 7").collect()
    kpis = dashboard.kpis(warehouse).first()
    assert [(r.revenue, r.profit) for r in total] == [(kpis.total_sales, kpis.total_profit)]


def test_in_minus_out_is_the_net_quantity(warehouse):
    for per in ("product", "row"):
        cells = cube.stock_changes(warehouse, ("MonthNumber", "Category"), per).collect()
        assert all(c.qty_in - c.qty_out == c.net_stock_change for c in cells)
    net = warehouse.totals("movements", [], {"q": "quantity"}).first().q
    assert sum(c.net_stock_change for c in cells) == net


def test_slice_with_and_without_counts_agree(warehouse):
    by = ["YearNumber", "Category", "CustomerCategory"]
    plain = warehouse.slice("sales", by, {"r": "revenue", "p": "profit", "n": "lines"})
    counted = warehouse.slice("sales", by, {"r": "revenue", "p": "profit", "n": "lines"}, {"c": "orders"})
    assert as_sets(plain.select(*by, "r", "p", "n")) == as_sets(counted.select(*by, "r", "p", "n"))


def test_orders_counted_as_rows_and_as_distinct_values_agree(warehouse):
    rows = warehouse.slice("sales", ["YearNumber"], {"r": "revenue"}, {"n": "orders"})
    distinct = warehouse.distinct_counts("sales", ["YearNumber"], {"n": "orders"})
    assert as_sets(rows.select("YearNumber", "n")) == as_sets(distinct)


def test_filters_equal_slicing_afterwards(warehouse):
    by, wanted = ["YearNumber", "Category"], [1996, 1998]
    filtered = warehouse.slice("sales", by, {"r": "revenue"}, filters={"YearNumber": wanted, "Category": ["PROMO"]})
    whole = warehouse.slice("sales", by, {"r": "revenue"})
    assert as_sets(filtered) == as_sets(whole.filter(F.col("YearNumber").isin(wanted) & (F.col("Category") == "PROMO")))


def test_a_month_without_sales(warehouse):
    assert monthly.month_totals(warehouse, 1950, 1).collect() == [(None, None, "N/A")]
    assert monthly.month_top_products(warehouse, 1950, 1).count() == 0


def test_text_order_of_months(warehouse):
    labels = [r.MonthYear for r in reports.sales_over_time(warehouse, text_order=True).collect()]
    assert labels == sorted(labels)
    dates = [dt.datetime.strptime(r.MonthYear, "%Y-%b") for r in reports.sales_over_time(warehouse).collect()]
    assert dates == sorted(dates)


def test_unknown_attribute(warehouse):
    with pytest.raises(KeyError, match="Colour"):
        warehouse.totals("sales", ["Colour"], {"r": "revenue"})


# Missing and skewed keys -----------------------------------------------------------------------------


def copy_tables(spark, folder, target, **changes):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        changes.get(name, lambda d: d)(df).write.parquet(f"{target}/{name}.parquet")
    return str(target)


@pytest.fixture(scope="module")
def skewed(spark, folder, tmp_path_factory):
    """A third of all lines in one order, of one product, from one supplier; a third of all orders by one customer."""
    def hot_lines(df):
        hot = F.pmod(F.xxhash64("l_shipdate", "l_extendedprice", "l_linenumber"), F.lit(3)) == 0
        return df.withColumns({
            c: F.when(hot, F.lit(7)).otherwise(F.col(c)).cast(df.schema[c].dataType)
            for c in ("l_orderkey", "l_partkey", "l_suppkey")
        })

    def hot_orders(df):
        return df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(F.col("o_custkey")))

    target = tmp_path_factory.mktemp("skewed")
    return copy_tables(spark, folder, target, lineitem=hot_lines, orders=hot_orders)


SKEW_CHECKED = (
    "kpis sales_trend top_products top_customers top_suppliers monthly_report sales_measures cube_slice cube_totals "
    "reference_dims qty_in_out customer_metrics customer_retention purchase_vs_sale margin_by_category fact_sales "
    "fact_financial dedupe first_category constraint_report forecast_summary supplier_performance customer_growth"
).split()


@pytest.mark.parametrize("name", SKEW_CHECKED)
def test_skewed_keys_without_broadcast(spark, skewed, name):
    """Results stay whole under skew, with every join shuffled and skewed partitions split early."""
    strict = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {key: spark.conf.get(key, None) for key in strict}
    try:
        for key, value in strict.items():
            spark.conf.set(key, value)
        line = compare(spark, views_over(skewed), skewed, name, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert not line.startswith("FAIL"), line


def test_skewed_partitions_are_split(spark, skewed):
    """The lines of the one large order and product are spread over several tasks."""
    strict = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {key: spark.conf.get(key, None) for key in strict}
    try:
        for key, value in strict.items():
            spark.conf.set(key, value)
        lines = spark.read.parquet(f"{skewed}/lineitem.parquet").repartition(8)
        tables = Tables(spark, skewed)
        tables._open["lineitem"] = lines
        df = LayoutWarehouse(tables).star("sales", ["InvoiceID", "InvoiceDate", "ProfitAmount"])
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def orphaned(spark, folder, tmp_path_factory):
    """Lines whose order, product or supplier is gone, and orders whose customer is."""
    target = tmp_path_factory.mktemp("orphaned")
    return copy_tables(
        spark, folder, target, orders=lambda d: d.filter("o_orderstatus <> 'P'"), part=lambda d: d.filter("p_size > 10"),
        supplier=lambda d: d.filter("s_suppkey % 5 > 0"), customer=lambda d: d.filter("c_custkey % 3 > 0"))


@pytest.fixture(scope="module")
def resolved(spark, orphaned, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("resolved"))
    return LayoutWarehouse(resolve(Tables(spark, orphaned), root)), root


def test_all_groupings_agree_over_resolved_tables(resolved):
    warehouse, _ = resolved
    sales = [[], ["YearNumber"], ["Category"], ["Product"], ["CustomerName"], ["CustomerCategory"], ["Country"],
             ["FullName"], ["DeliveryMethod"], ["InvoiceID"], ["Brand", "YearNumber"], ["Category", "CustomerCategory"]]
    bought = [[], ["YearNumber"], ["ExpectedYearNumber"], ["Category"], ["SupplierName"], ["SupplierCategory"], ["Country"],
              ["DeliveryMethod"], ["PurchaseOrderID"], ["Brand", "SupplierCategory"]]
    for fact, measure, groupings in (("sales", "revenue", sales), ("purchases", "cost_at_order", bought)):
        totals = {sum(r.v for r in warehouse.totals(fact, by, {"v": measure}).collect()) for by in groupings}
        assert len(totals) == 1, totals


RESOLVED = (
    "kpis revenue_trend sales_trend top_products top_customers sales_by_category top_suppliers purchase_trend "
    "products_sold monthly_report sales_measures purchase_measures qty_in_out receivables cube_totals sales_details "
    "margin_by_category customers_this_year customer_metrics category_margin average_order_value supplier_performance"
).split()


@pytest.mark.parametrize("name", RESOLVED)
def test_queries_over_resolved_tables(spark, orphaned, resolved, name):
    warehouse, root = resolved
    database = views_over(orphaned)
    for table in ("orders", "lineitem"):
        database.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
    plan = {**entry.WAREHOUSE_PLANS, **entry.CUBE_PLANS, **entry.QUESTION_PLANS}[name]
    before = entry.warehouse
    try:
        entry.warehouse = lambda spark, folder: warehouse
        line = compare(spark, database, orphaned, name, plan, entry.oracle_sql()[name])
    finally:
        entry.warehouse = before
    assert not line.startswith("FAIL"), line


def test_constraint_report_counts_orphans(spark, orphaned):
    broken = {(r.table_name, r.column_name): r.violations
              for r in loads.constraint_report(Tables(spark, orphaned)).filter("rule = 'foreign_key'").collect()}
    lines = spark.read.parquet(f"{orphaned}/lineitem.parquet")
    parts = spark.read.parquet(f"{orphaned}/part.parquet")
    assert broken["lineitem", "l_partkey"] == lines.join(parts, lines.l_partkey == parts.p_partkey, "left_anti").count() > 0


# Stored warehouse ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, warehouse, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    store_warehouse(warehouse, root)
    return StoredWarehouse(spark, root)


STORED_PLANS = [
    dashboard.kpis, dashboard.sales_trend, dashboard.top_products, dashboard.top_customers, dashboard.top_suppliers,
    dashboard.purchase_trend, dashboard.low_stock, dashboard.years, monthly.monthly_report, cube.sales_measures,
    cube.purchase_measures, cube.inventory_measures, cube.financial_measures, cube.sales_cube, cube.role_dates,
    cube.reference_dims, cube.unknown_member, reports.margin_by_category, reports.quantities_over_time,
    adhoc.customers_this_year_cte, adhoc.customer_metrics, adhoc.year_vs_last, forecasting.linear_trend,
]


@pytest.mark.parametrize("plan", STORED_PLANS, ids=lambda p: p.__name__)
def test_stored_warehouse_answers_alike(warehouse, stored, plan):
    assert as_sets(plan(stored)) == as_sets(plan(warehouse))


def test_stored_warehouse_reads_one_year(stored):
    plan = plan_of(dashboard.sales_trend(stored, 1998))
    assert "PartitionFilters: [isnotnull(LoadYear" in plan
    assert "(LoadYear" in plan and "<= 1999" in plan and ">= 1998" in plan


# Plans -----------------------------------------------------------------------------------------------


def test_only_needed_columns_are_read(warehouse):
    plan = plan_of(dashboard.revenue_trend(warehouse))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "part.parquet" not in plan and "customer.parquet" not in plan


def test_year_reaches_the_scan(warehouse):
    plan = plan_of(dashboard.top_customers(warehouse, 1998))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,1999-01-01T00:00)" in plan


def test_nothing_forces_a_broadcast_of_a_growing_table(spark, warehouse):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (dashboard.sales_trend, dashboard.top_customers, cube.sales_measures, cube.reference_dims):
            text = plan_of(plan(warehouse))
            assert "Broadcast" not in text and "Cartesian" not in text, plan.__name__
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranking_per_month_is_cut_before_its_shuffle(warehouse):
    assert "WindowGroupLimit" in plan_of(monthly.monthly_report(warehouse))


# SQL -------------------------------------------------------------------------------------------------


def test_adhoc_sql_is_cut(warehouse):
    assert adhoc.adhoc_sql(warehouse, "SELECT * FROM FactSales;").count() == 50
    assert adhoc.adhoc_sql(warehouse, "SELECT DateKey FROM DimDate", rows=3).count() == 3


@pytest.mark.parametrize("text", ["DROP VIEW DimDate", "CREATE TABLE t AS SELECT 1", "SELECT 1) t; DROP VIEW x; (SELECT 2"])
def test_adhoc_sql_only_reads(warehouse, text):
    with pytest.raises(Exception, match="PARSE|parse|Syntax|syntax"):
        adhoc.adhoc_sql(warehouse, text).collect()


# Forecast --------------------------------------------------------------------------------------------


def test_horizon():
    assert [forecasting.horizon_days(m) for m in (1, 2, 3, 6, 12)] == [30, 60, 91, 182, 365]


def test_fit_recovers_line_and_week():
    days = np.arange(400)
    values = 50 + 0.3 * days + 10 * np.sin(2 * np.pi * days / 7)
    every, fitted, width = forecasting.fit_series(days, values, 30)
    ahead = np.arange(400, 430)
    assert list(every[-30:]) == list(ahead)
    expected = 50 + 0.3 * ahead + 10 * np.sin(2 * np.pi * ahead / 7)
    assert np.abs(fitted[-30:] - expected).max() < 3.0 and width[:400].max() < 2.0
    assert (np.diff(width[400:]) >= 0).all()


def test_fit_follows_a_broken_slope_and_leaves_noise_straight():
    days, random = np.arange(500), np.random.default_rng(5)
    trend = np.where(days < 250, 100 + 0.4 * days, 200 - 0.3 * (days - 250))
    noise = random.normal(0, 4, 500)
    every, fitted, width = forecasting.fit_series(days, trend + noise, 60)
    ahead = 200 - 0.3 * (every[500:] - 250)
    assert np.abs(fitted[500:] - ahead).max() < 15
    assert (fitted[:250] - trend[:250]).std() < 4 and fitted[553:560].mean() < fitted[500:507].mean() - 10
    assert width[-1] > 1.1 * width[0] and (np.abs(fitted[500:] - ahead) <= width[500:]).all()
    straight, fitted, width = forecasting.fit_series(days, 100 + random.normal(0, 4, 500), 60)
    assert np.abs(fitted[500:] - 100).max() < 8 and width[-1] < 1.01 * width[0]


@pytest.mark.parametrize("seed", range(6))
def test_changes_are_the_exact_minimum(seed):
    random = np.random.default_rng(seed)
    points = random.normal(size=(40, 12)).cumsum(axis=0 if seed % 2 else 1)
    gram, pull = points.T @ points, points.T @ random.normal(size=40)
    price = float(np.abs(pull).max()) * (0.02, 0.2, 0.9)[seed % 3]
    found, plain = forecasting.few_changes(gram, pull, price), np.zeros(12)
    cost = lambda d: d @ gram @ d / 2 - pull @ d + price * np.abs(d).sum()
    for _ in range(5000):  # one change at a time
        for j in range(12):
            rest = pull[j] - gram[j] @ plain + gram[j, j] * plain[j]
            plain[j] = np.sign(rest) * max(abs(rest) - price, 0) / gram[j, j]
    assert cost(found) <= cost(plain) + 1e-9 * abs(cost(plain))
    assert np.abs(pull - gram @ found).max() <= price * (1 + 1e-6)
    assert not forecasting.few_changes(gram, pull, float(np.abs(pull).max()) * 1.01).any()


@pytest.mark.parametrize("values", [[5.0] * 12, [0.0] * 12, list(range(12)), [0.0] * 11 + [1e9]])
def test_fit_of_plain_series(values):
    every, fitted, width = forecasting.fit_series(np.arange(12), np.array(values), 5)
    assert len(every) == len(fitted) == len(width) == 17 and np.isfinite(fitted).all() and np.isfinite(width).all()


def test_forecast_covers_history_and_horizon(spark):
    history = spark.sql(
        "SELECT p AS ProductKey, date_add(DATE'2016-01-01', d) AS ds, 100D + d AS y "
        "FROM (SELECT explode(sequence(1, 3)) AS p), (SELECT explode(sequence(0, 19)) AS d)"
    )
    got = forecasting.seasonal_forecast(history, 1)
    counts = as_sets(got.groupBy("ProductKey", "is_future").count())
    assert counts == [(p, f, 30 if f else 20) for p in (1, 2, 3) for f in (False, True)]
    assert got.filter("yhat_lower > yhat OR yhat > yhat_upper").count() == 0


def test_summary_thresholds(spark):
    history = spark.createDataFrame(
        [(p, day("2016-01-01") + dt.timedelta(i), 10.0) for p in range(1, 6) for i in range(40)],
        "ProductKey BIGINT, ds DATE, y DOUBLE",
    )
    levels = {1: 10.0, 2: 10.6, 3: 9.4, 4: 25.0, 5: -3.0}
    predicted = spark.createDataFrame(
        [(p, day("2016-02-10") + dt.timedelta(i), v, v - 1, v + 1) for p, v in levels.items() for i in range(30)],
        "ProductKey BIGINT, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE",
    )
    got = {r.ProductKey: r for r in forecasting.summarize(history, predicted, 1).collect()}
    assert {p: (r.pct_change, r.trend, r.implausible_growth) for p, r in got.items()} == {
        1: (0.0, "flat", False), 2: (6.0, "up", False), 3: (-6.0, "down", False), 4: (150.0, "up", True),
        5: (-100.0, "down", False),
    }
    assert (got[1].recent_actual, got[1].low_total, got[5].forecast_total) == (300.0, 270.0, 0.0)


def test_summary_without_recent_sales(spark):
    history = spark.createDataFrame([(1, day("2016-01-01"), 0.0)], "ProductKey BIGINT, ds DATE, y DOUBLE")
    predicted = spark.createDataFrame([(1, day("2016-01-02"), 1.0, 1.0, 1.0)],
                                      "ProductKey BIGINT, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE")
    row = forecasting.summarize(history, predicted, 1).first()
    assert (row.pct_change, row.trend, row.implausible_growth) == (None, "flat", False)


def test_actuals_and_forecast_meet_by_day(spark):
    history = spark.createDataFrame([(1, day("2016-01-01"), 5.0), (1, day("2016-01-02"), 6.0)],
                                    "ProductKey BIGINT, ds DATE, y DOUBLE")
    predicted = spark.createDataFrame(
        [(1, day("2016-01-02"), 1.0, 0.0, 2.0), (1, day("2016-01-03"), 1.5, 0.5, 2.5)],
        "ProductKey BIGINT, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE",
    )
    got = forecasting.join_actuals(history, predicted).select("ds", "actual", "yhat")
    assert as_sets(got) == [(day("2016-01-01"), 5.0, None), (day("2016-01-02"), 6.0, 1.0), (day("2016-01-03"), None, 1.5)]


def test_short_history_is_left_out(warehouse):
    counts = {r.ProductKey: r.points for r in forecasting.linear_trend(warehouse).collect()}
    assert counts and min(counts.values()) >= forecasting.MIN_POINTS
    assert forecasting.daily_history(warehouse, -1).count() == 0


# Stream ----------------------------------------------------------------------------------------------


def test_stream_equals_batch_and_picks_up_new_files(spark, tables, folder, tmp_path):
    op, load, lines = Operational(tables), loads.loaded_star(tables), tables.read("lineitem")
    source = str(tmp_path / "lineitem.parquet")
    for name in ("orders", "part"):
        os.symlink(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")

    def batch(some):
        return facts.fact_sales(op.invoices(), Operational(tables.replaced(lineitem=some)).invoice_details(), load.dims())

    def run():
        stream = loads.sales_stream(Tables(spark, str(tmp_path)), load, str(tmp_path / "out"))
        stream.run(spark, files_per_batch=1)
        return as_sets(spark.read.parquet(stream.output).select(batch(lines).columns))

    lines.filter("l_linestatus = 'O'").repartition(2).write.mode("append").parquet(source)
    assert run() == as_sets(batch(lines.filter("l_linestatus = 'O'")))
    assert run() == as_sets(batch(lines.filter("l_linestatus = 'O'")))
    lines.filter("l_linestatus = 'F'").write.mode("append").parquet(source)
    assert run() == as_sets(batch(lines))


class Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, master, **settings):
        self.conf, self.settings = self, settings
        self.sparkContext = type("Context", (), {"master": master})

    def get(self, key, default):
        return self.settings.get(key, default)


def test_shared_dir_follows_the_session():
    named = Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    assert shared_dir(named) == "hdfs://shared/checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))
    local = Session("local[4]")
    assert os.path.isdir(shared_dir(local)) and shared_dir(local) == shared_dir(local)


def test_series_are_fitted_together_as_one_by_one():
    random = np.random.default_rng(3)
    days = [np.sort(random.choice(1500, n, replace=False)) + 9000 for n in (10, 400, 37, 10, 1200)]
    values = [random.gamma(2, 100, len(d)) + np.maximum(d - 9700, 0) * i for i, d in enumerate(days)]
    for many, d, v in zip(forecasting.fit_many(days, values, 40), days, values, strict=True):
        for got, want in zip(many, forecasting.fit_series(d, v, 40), strict=True):
            assert got.shape == (len(d) + 40,) and np.allclose(got, want, rtol=1e-9)


def test_forecast_of_series_cut_by_batches(spark):
    days, random = np.arange(9000, 9400), np.random.default_rng(4)
    series = {key: random.gamma(2, 100, len(days)) for key in (None, 0, 5, 6)}
    rows = [(k, dt.date(1970, 1, 1) + dt.timedelta(int(d)), float(y)) for k, v in series.items() for d, y in zip(days, v)]
    random.shuffle(rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        found = forecasting.seasonal_forecast(spark.createDataFrame(rows, "ProductKey BIGINT, ds DATE, y DOUBLE"), 1).collect()
    finally:
        spark.conf.set(key, before)
    for k, v in series.items():
        mine = sorted((r for r in found if r.ProductKey == k), key=lambda r: r.ds)
        _, fitted, width = forecasting.fit_series(days, v, 30)
        assert [r.is_future for r in mine] == [False] * 400 + [True] * 30
        assert np.allclose([r.yhat for r in mine], fitted) and np.allclose([r.yhat_upper - r.yhat for r in mine], width)


def test_forecast_is_made_once_to_be_compared(warehouse):
    plan = forecasting.forecast_fit(warehouse)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan
