"""The sales load as two streams: files in any order, repeated files, invoices that come late, and bounded state."""

import os

import pytest
from pyspark.sql import functions as F

from starcellar.layout import Tables
from starcellar.plans import loads
from starcellar.streaming.sales import ON_DISK, STORE, Side, dropped, state_rows

DAY = 86_400


@pytest.fixture(scope="module")
def load(tables):
    return loads.loaded_star(tables)


def put(df, folder, day):
    """Write a part as one file that arrived on a day."""
    aside = f"{folder}-{day}"
    df.coalesce(1).write.mode("append").parquet(aside)
    os.makedirs(folder, exist_ok=True)
    for name in (n for n in os.listdir(aside) if n.startswith("part-")):
        os.rename(f"{aside}/{name}", f"{folder}/day-{day}-{name}")
        os.utime(f"{folder}/day-{day}-{name}", (1_700_000_000 + day * DAY,) * 2)


def months(sales):
    return [(r.month, r.line_count, round(r.revenue, 4)) for r in loads._by_month(sales).orderBy("month").collect()]


def parted(spark, folder, name, key, parts):
    rows = spark.read.parquet(f"{folder}/{name}.parquet").filter("{0} % 10 < 6".format(key))
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == n) for n in range(parts)]


def test_any_order_repeats_and_late_invoices(spark, folder, tmp_path, load):
    heads, lines = (parted(spark, folder, *x, 3) for x in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    os.symlink(f"{folder}/part.parquet", f"{tmp_path}/part.parquet")
    o, i = f"{tmp_path}/orders.parquet", f"{tmp_path}/lineitem.parquet"
    put(lines[0], i, 0)
    put(heads[1], o, 1)  # before its lines
    put(heads[0], o, 2)  # after its lines
    put(lines[1], i, 3)
    put(lines[0], i, 4)  # repeated
    put(lines[2], i, 5)  # its invoices come too late
    tables = Tables(spark, str(tmp_path))
    stream = loads.sales_stream(tables, load, f"{tmp_path}/out")
    first = stream.run(spark, files_per_batch=1)
    want = months(loads.fact_sales(Tables(spark, folder).replaced(
        orders=heads[0].unionByName(heads[1]), lineitem=lines[0].unionByName(lines[1]))))
    assert months(spark.read.parquet(stream.output)) == want
    assert not any(map(dropped, first))

    put(heads[1].limit(0), o, 30)  # only moves the watermark of each side
    put(heads[2], o, 31)
    put(lines[0].limit(1), i, 32)  # a repeated line, long after it was known for one
    second = loads.sales_stream(Tables(spark, str(tmp_path)), load, f"{tmp_path}/out").run(spark, files_per_batch=1)
    whole = Tables(spark, folder).replaced(
        orders=heads[0].unionByName(heads[1]).unionByName(heads[2]),
        lineitem=lines[0].unionByName(lines[1]).unionByName(lines[2]))
    assert months(spark.read.parquet(stream.output)) == months(loads.fact_sales(whole))
    assert spark.read.parquet(stream.late).select("l_orderkey").distinct().count() > 0
    rows = whole.read("orders").count() + whole.read("lineitem").count()
    assert state_rows(second[-1]) < rows / 2 < max(map(state_rows, first))
    loads.sales_stream(Tables(spark, str(tmp_path)), load, f"{tmp_path}/out").run(spark)  # nothing new
    assert months(spark.read.parquet(stream.output)) == months(loads.fact_sales(whole))
    assert spark.conf.get(STORE) != ON_DISK  # the session's own streams keep their store
    assert not [o for run in (first, second) for p in run for o in p["stateOperators"] if "rocksdbPutCount" not in o["customMetrics"]]


def test_rows_are_told_apart_by_a_digest_of_their_columns(spark, tmp_path):
    rows = [(1, None, "a"), (None, 1, "a"), (1, 1, None), (1, 1, "a"), (1, 1, "a"), (1, None, "a"), (1, None, None), (None, 1, None)]
    given = spark.createDataFrame(rows, "k long, n long, s string")
    given.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = Side(f"{tmp_path}/in", given.schema, "k", ("k", "n", "s")).stream(spark, "arrived", "7 days", None)
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark [_told#" in plan, plan
    assert kept.columns == ["k", "n", "s", "arrived"]
    found = []
    query = kept.writeStream.foreachBatch(lambda df, n: found.extend((r.k, r.n, r.s) for r in df.collect()))
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(found, key=repr) == sorted(set(rows), key=repr)
