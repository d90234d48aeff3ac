"""The load of the whole star: one commit, deaths anywhere, late documents, versions of products, and queries over it."""

import datetime as dt
import random
import threading
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import as_sets

from starcellar.operational import Operational
from starcellar.operators.as_of import as_of_lookup
from starcellar.plans import dashboard, loads
from starcellar.plans.loaded_warehouse import LoadedWarehouse
from starcellar.plans.loads import MARK
from starcellar.plans.rollups import KEPT, is_long, keep_up
from starcellar.plans.star_load import ALWAYS, FACT_LOADS, RUN_SETTINGS, StarLoad
from starcellar.session import settings
from starcellar.sources.snapshots import Snapshot, Snapshots

FACTS = {
    "FactSales": loads.fact_sales, "FactPurchases": loads.fact_purchases,
    "FactInventoryTransactions": loads.fact_inventory_transactions, "FactFinancialTransactions": loads.fact_financial,
    "FactInventory": loads.fact_inventory,
}


def stored(load, name):
    rows = loads.with_doubles(load.by_natural_keys(name))
    return as_sets(rows.select(FACTS[name](load.source.tables).columns))


class Dies(Exception):
    pass


def dying(monkeypatch, method, calls):
    """Make a method of the snapshots fail from its n-th call on."""
    real, lock, seen = getattr(Snapshots, method), threading.Lock(), []

    def run(self, *args, **kwargs):
        with lock:
            seen.append(1)
            if len(seen) >= calls:
                raise Dies
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Snapshots, method, run)


def test_two_loads_with_deaths_late_invoices_and_changed_products(tables, tmp_path, monkeypatch):
    late = "o_orderdate BETWEEN timestamp'1998-06-27' AND timestamp'1998-06-30' AND o_orderkey % 2 = 0"
    early = tables.replaced(orders=tables.read("orders").filter(f"NOT ({late})"))
    first = StarLoad(Operational(early), str(tmp_path))
    first.load(until=MARK)
    before = LoadedWarehouse(first.store)
    assert before.snapshot.number == 1 and set(before.snapshot.marks) == set(FACT_LOADS)
    seen = as_sets(dashboard.kpis(before))

    changed = tables.replaced(part=tables.read("part").withColumn(
        "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.lit("Renamed")).otherwise(F.col("p_brand"))))
    second = StarLoad(Operational(changed), str(tmp_path))
    for method, calls in (("write", 4), ("publish", 1)):
        with monkeypatch.context() as patch:
            dying(patch, method, calls)
            with pytest.raises(Dies):
                second.load(lookback_days=5)
        assert second.store.current() == before.snapshot
        assert as_sets(dashboard.kpis(LoadedWarehouse(second.store))) == seen

    second.load(lookback_days=5)
    for name in FACTS:
        assert stored(second, name) == as_sets(FACTS[name](changed)), name
    assert as_sets(dashboard.kpis(before)) == seen  # a reader keeps the snapshot it opened

    since = second.by_natural_keys("FactSales").select(
        "ProductKey", (F.col("InvoiceDateKey") > int(MARK.strftime("%Y%m%d"))).alias("after"), "ProductSince").distinct()
    mark = before.snapshot.marks["FactSales"] + dt.timedelta(1)
    assert {(r.ProductKey % 3 == 0, r.after, r.ProductSince) for r in since.collect()} == {
        (True, False, ALWAYS), (True, True, mark), (False, False, ALWAYS), (False, True, ALWAYS)}


def test_a_withdrawn_run_leaves_nothing(tables, tmp_path):
    load = StarLoad(Operational(tables), str(tmp_path))
    load.load_dimensions()
    load.load_sales(until=MARK)
    rows = load.sales().count()
    load.append_sales()  # dies before its mark, and the source withdraws the newer orders
    fewer = StarLoad(Operational(tables.replaced(orders=tables.read("orders").filter("o_orderdate <= timestamp'1998-06-30'"))),
                     str(tmp_path))
    held = load.store.current()
    assert fewer.load_sales() == load.marks.read("FactSales") <= MARK
    assert fewer.sales().count() == rows
    again = fewer.store.current()
    assert again.number == held.number + 1 and again.parts == held.parts and again.marks == held.marks


def test_a_run_frees_its_shuffles_and_writes_long_tables_in_turn(spark, tables, tmp_path, monkeypatch):
    shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    long_tables = {*FACT_LOADS, *(k.table for k in KEPT if is_long(k))}
    real, lock, now, seen, met = Snapshots.write, threading.Lock(), set(), set(), []

    def write(self, df, table, *args, **kwargs):
        with lock:
            met.append((table, sorted(now & long_tables)))
            now.add(table)
            seen.update((key, spark.conf.get(key)) for key in RUN_SETTINGS)
        try:
            return real(self, df, table, *args, **kwargs)
        finally:
            with lock:
                now.discard(table)

    monkeypatch.setattr(Snapshots, "write", write)
    session = {key: spark.conf.get(key) for key in RUN_SETTINGS}
    held = shuffles()
    load = StarLoad(Operational(tables), str(tmp_path), (keep_up,))
    load.load(until=MARK)
    assert shuffles() <= held + 8  # those of a few small fetches and checks at most; a run has more than 60
    assert seen == set(RUN_SETTINGS.items()) and {key: spark.conf.get(key) for key in RUN_SETTINGS} == session
    assert {table for table, _ in met} >= long_tables
    assert [m for m in met if m[0] in long_tables and m[1]] == []
    for table in ("FactSales", "SalesByProduct"):
        files = sorted(tmp_path.glob(f"{table}/**/*.parquet"))
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_settings_come_back(spark):
    key, other = "spark.sql.sources.fileCompressionFactor", "starcellar.test.setting"
    before = spark.conf.get(key)
    with pytest.raises(Dies), settings(spark, {key: "3", other: "1"}):
        assert (spark.conf.get(key), spark.conf.get(other)) == ("3", "1")
        raise Dies
    assert (spark.conf.get(key), spark.conf.get(other, None)) == (before, None)


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.current() == Snapshot()
    rows = spark.range(5).withColumn("y", F.lit(1).cast("int"))
    schema = '{"type":"struct","fields":[{"name":"id","type":"long","nullable":true,"metadata":{}},' \
             '{"name":"y","type":"integer","nullable":true,"metadata":{}},{"name":"part","type":"string","nullable":true,"metadata":{}}]}'
    one, two = store.write(rows, "t", ("y",)), store.write(rows, "t", ("y",))
    assert store.current() == Snapshot()
    day = dt.date(2000, 1, 2)
    store.publish(Snapshot(1, {"t": (one,), "u": ()}, {"t": schema, "u": schema}, {"t": day}))
    held = store.current()
    assert held.number == 1 and held.parts == {"t": (one,), "u": ()} and held.marks == {"t": day}
    store.publish(Snapshot(10, {"t": (one, two)}, {"t": schema}, {}))
    assert store.read("t", held).count() == 5 and store.read("u", held).count() == 0
    now = store.current()
    assert now.number == 10 and store.read("t", now).count() == 10 and set(store.read("t", now).columns) == {"id", "y", "part"}


def test_as_of_lookup_against_every_version(spark):
    draw, start = random.Random(3), dt.date(2000, 1, 1)
    day = lambda n: start + dt.timedelta(n)
    versions = [(k, day(n), f"{k}-{n}") for k in range(12) for n in sorted(draw.sample(range(60), draw.randint(0, 5)))]
    rows = [(i, draw.choice([0, 0, 0, *range(15), None]), draw.choice([day(draw.randint(0, 70)), None])) for i in range(900)]
    want = []
    for i, k, d in rows:
        valid = [v for v in versions if v[0] == k and d is not None and v[1] <= d]
        want.append((i, k, d, max(valid, key=lambda v: v[1])[2] if valid else None))
    found = as_of_lookup(
        spark.createDataFrame(rows, "i INT, k INT, d DATE").repartition(3),
        spark.createDataFrame(versions, "k INT, since DATE, name STRING"), "k", "d", "since", ["name"])
    assert as_sets(found) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = as_of_lookup(spark.createDataFrame(rows, "i INT, k INT, d DATE"),
                         spark.createDataFrame([], "k INT, since DATE, name STRING"), "k", "d", "since", ["name"])
    assert {r.name for r in empty.collect()} == {None}


def test_as_of_lookup_shuffles_its_rows_once(spark):
    rows = spark.range(100).selectExpr("id AS i", "id % 7 AS k", "date_add(date'2020-01-01', CAST(id AS INT)) AS d")
    versions = spark.createDataFrame([(1, dt.date(2020, 1, 5), "a"), (1, dt.date(2020, 2, 1), "b")], "k BIGINT, s DATE, v STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = as_of_lookup(rows, versions, "k", "d", "s", ["v"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2, plan  # of the rows and of the versions
        assert {(r.i, r.v) for r in found.collect() if r.v} == {(i, "a" if i < 31 else "b") for i in range(8, 100, 7)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entry_without_the_optional_queries():
    import __spark_entry__ as entry
    assert SimpleNamespace(**entry.LOADED_PLANS) and set(entry.LOADED_PLANS) <= set(entry.oracle_sql())
