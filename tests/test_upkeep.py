"""Change detection, upserts, history, the load log, sinks and incremental loads."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import as_sets, day
from starcellar.operators import facts, upkeep
from starcellar.sources.sinks import (
    WatermarkStore, append_sink, current_version, read_versioned, reload_sink, write_versioned,
)

SHAPE = "k INT, a INT, b STRING"
COLUMNS = ("a", "b")


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SHAPE)


OLD = {1: (1, "x"), 2: (2, None), 3: (3, "z"), 4: (None, "w")}
NEW = {1: (1, "x"), 2: (2, "now"), 4: (None, "w"), 5: (5, "v")}


def test_change_set(spark):
    got = dict(as_sets(upkeep.change_set(frame(spark, OLD), frame(spark, NEW), "k", COLUMNS)))
    assert got == {1: "unchanged", 2: "changed", 3: "missing", 4: "unchanged", 5: "new"}


def test_upsert_replaces_adds_and_keeps(spark):
    got = as_sets(upkeep.upsert(frame(spark, OLD), frame(spark, NEW), "k", COLUMNS))
    assert got == sorted(((k, *v) for k, v in {**OLD, **NEW}.items()), key=repr)


def test_upsert_keeps_incoming_nulls(spark):
    got = upkeep.upsert(frame(spark, {1: (1, "x")}), frame(spark, {1: (None, None)}), "k", COLUMNS)
    assert as_sets(got) == [(1, None, None)]


rows = st.dictionaries(st.integers(0, 6), st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["x", "y", None])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=rows, new=rows)
def test_upsert_twice_is_once(spark, old, new):
    stored, incoming = frame(spark, old), frame(spark, new)
    once = upkeep.upsert(stored, incoming, "k", COLUMNS)
    assert as_sets(once) == as_sets(upkeep.upsert(once, incoming, "k", COLUMNS))
    assert as_sets(once) == sorted(((k, *v) for k, v in {**old, **new}.items()), key=repr)


def test_history_opens_and_closes(spark):
    first, second, third = day("2020-01-01"), day("2020-02-01"), day("2020-03-01")
    history = upkeep.first_history(frame(spark, OLD), first)
    history = upkeep.dim_history(history, frame(spark, NEW), "k", COLUMNS, second)
    assert as_sets(history) == sorted([
        (1, 1, "x", first, None, True), (2, 2, None, first, second, False), (2, 2, "now", second, None, True),
        (3, 3, "z", first, None, True), (4, None, "w", first, None, True), (5, 5, "v", second, None, True),
    ], key=repr)
    assert as_sets(upkeep.dim_history(history, frame(spark, NEW), "k", COLUMNS, third)) == as_sets(history)
    current = upkeep.current_rows(history).select("k", *COLUMNS)
    assert as_sets(current) == as_sets(upkeep.upsert(frame(spark, OLD), frame(spark, NEW), "k", COLUMNS))


def test_versions_switch(spark, tmp_path):
    root = str(tmp_path / "t")
    assert current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_versioned(spark, root)
    write_versioned(spark.range(3), root)
    old = read_versioned(spark, root)
    write_versioned(read_versioned(spark, root).filter("id > 0"), root)
    assert as_sets(old) == [(0,), (1,), (2,)]
    assert as_sets(read_versioned(spark, root)) == [(1,), (2,)]


def test_append_and_reload(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(4).withColumn("p", F.col("id") % 2)
    append_sink(df, path, ("p",))
    append_sink(df, path, ("p",))
    assert spark.read.parquet(path).count() == 8
    reload_sink(spark.range(1).withColumn("p", F.lit(1).cast("bigint")), path, ("p",), only_partitions=True)
    assert as_sets(spark.read.parquet(path).groupBy("p").count()) == [(0, 4), (1, 1)]
    reload_sink(spark.range(1).withColumn("p", F.lit(1).cast("bigint")), path, ("p",))
    assert spark.read.parquet(path).count() == 1


def test_watermarks(spark, tmp_path):
    store = WatermarkStore(spark, str(tmp_path / "log"))
    dates = spark.createDataFrame([(day("2016-01-01"),), (day("2016-01-05"),)], "d DATE")
    assert store.read("sales") is None
    assert store.advance("sales", dates) == day("2016-01-05")
    assert store.advance("purchases", dates.limit(1)) == day("2016-01-01")
    assert store.advance("sales", dates.limit(0)) == day("2016-01-05")
    assert as_sets(store.table()) == [("purchases", day("2016-01-01")), ("sales", day("2016-01-05"))]


SOURCE = [(1, "2016-01-01"), (2, "2016-01-02"), (3, "2016-01-02"), (4, "2016-01-03")]


@pytest.mark.parametrize("mark", [None, "2015-12-31", "2016-01-01", "2016-01-02", "2016-01-03"])
def test_initial_and_incremental_make_the_whole(spark, mark):
    source = spark.createDataFrame([(k, day(d)) for k, d in SOURCE], "k INT, d DATE")
    mark = mark and day(mark)
    before = source.filter(F.col("d") <= F.lit(mark)) if mark else source.limit(0)
    assert as_sets(before.unionByName(facts.newer_rows(source, "d", mark))) == as_sets(source)


def test_late_rows_of_the_last_days(spark):
    source = spark.createDataFrame([(k, day(d)) for k, d in SOURCE], "k INT, d DATE")
    loaded = spark.createDataFrame([(2,)], "k INT")
    mark = day("2016-01-02")
    assert as_sets(facts.late_rows(source, "d", mark, 1, loaded, "k")) == [(3, day("2016-01-02"))]
    assert facts.late_rows(source, "d", mark, 2, loaded, "k").count() == 2
    assert facts.late_rows(source, "d", mark, 0, loaded, "k").count() == 0
    assert facts.late_rows(source, "d", None, 5, loaded, "k").count() == 0
