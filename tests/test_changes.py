"""Tables changed row by row: buckets that a change rewrites, events in any order, and rows that break rules."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import as_sets

from starcellar.operators.buckets import DELETE, INSERT, UPDATE, BucketedTable
from starcellar.operators.rejects import CheckedTable, with_reasons
from starcellar.schemas import Rules
from starcellar.sources.snapshots import Snapshots


def test_one_changed_row_rewrites_one_bucket(spark, tmp_path):
    table = BucketedTable(Snapshots(spark, str(tmp_path)), "t", "k", ("v", "w"), buckets=8)
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    assert len(table.upsert(rows)) == 8
    before, folders = set(table.parts()), set(os.listdir(f"{tmp_path}/t"))
    changed = rows.withColumn("v", F.when(F.col("k") == 7, F.lit(None)).otherwise(F.col("v")))
    written = table.upsert(changed)
    after = set(table.parts())
    assert len(written) == 1 and len(after - before) == len(before - after) == 1
    (new,) = set(os.listdir(f"{tmp_path}/t")) - folders
    assert [d for d in os.listdir(f"{tmp_path}/t/{new}") if d.startswith("bucket=")] == [f"bucket={written[0]}"]
    assert as_sets(table.read()) == as_sets(changed)
    assert table.upsert(changed) == [] and set(table.parts()) == after
    assert table.upsert(changed.filter("k < 5").union(spark.createDataFrame([(900, 1, "new")], "k LONG, v LONG, w STRING")))
    assert as_sets(table.read().filter("k = 900 OR k = 7")) == [(7, None, "x"), (900, 1, "new")] and table.read().count() == 201


def test_events_in_any_order_and_cutting(spark, tmp_path):
    draw = random.Random(5)
    events = [(draw.randint(0, 12), draw.choice([INSERT, UPDATE, UPDATE, DELETE]), n // 2, draw.choice([None, n])) for n in range(120)]
    last = {}
    for k, op, seq, v in events:
        mark = (seq, op == DELETE, v is not None, v or 0)
        if k not in last or mark > last[k][0]:
            last[k] = (mark, op, v)
    want = sorted(((k, v) for k, (_, op, v) in last.items() if op != DELETE), key=repr)
    for n, runs in enumerate((1, 3)):
        table = BucketedTable(Snapshots(spark, f"{tmp_path}/{n}"), "t", "k", ("v",), buckets=4)
        given = [*events, *events[:30]]
        draw.shuffle(given)
        for part in range(runs):
            df = spark.createDataFrame([*given[part::runs], (None, UPDATE, 999, 1), (3, DELETE, None, 1)],
                                       "k INT, op STRING, seq INT, v INT")
            table.apply(df, "op", "seq")
        assert as_sets(table.read()) == want
    unique = [(k, op, 1000 + n, v) for n, (k, op, _, v) in enumerate(events)]
    state = {k: (op, v) for k, op, _, v in unique}
    table = BucketedTable(Snapshots(spark, f"{tmp_path}/u"), "t", "k", ("v",), buckets=4)
    mixed = draw.sample(unique, len(unique))
    for part in range(3):
        table.apply(spark.createDataFrame(mixed[part::3], "k INT, op STRING, seq INT, v INT"), "op", "seq")
    assert as_sets(table.read()) == sorted(((k, v) for k, (op, v) in state.items() if op != DELETE), key=repr)
    assert table.apply(spark.createDataFrame(mixed[::3], "k INT, op STRING, seq INT, v INT"), "op", "seq") == []


def test_reading_what_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        BucketedTable(Snapshots(spark, str(tmp_path)), "t", "k", ("v",)).read()


RULES = Rules("id", ("id", "name"), {"parent": ("parents", "p")}, {"positive": "n > 0"}, {"name": 3})


def test_reasons_and_quarantine(spark, tmp_path):
    parents = {"parents": spark.createDataFrame([(1,), (1,), (2,), (None,)], "p INT")}
    rows = [(1, "a", 1, 5), (2, "long", 2, 5), (3, None, 9, -1), (4, "b", None, None), (5, "c", 1, 1), (5, "d", 1, 1), (None, "e", 1, 1)]
    df = spark.createDataFrame(rows, "id INT, name STRING, parent INT, n INT")
    got = {(r.id, r.name): r.reasons for r in with_reasons(df, RULES, parents).collect()}
    assert got == {
        (1, "a"): [], (2, "long"): ["length name"], (3, None): ["not_null name", "check positive", "foreign_key parent"],
        (4, "b"): [], (5, "c"): ["primary_key id"], (5, "d"): ["primary_key id"], (None, "e"): ["not_null id"]}
    table = CheckedTable(spark, str(tmp_path), RULES)
    table.append(df, "one", parents)
    table.append(df, "two", parents)
    table.append(df.filter("id = 1"), "two", parents)  # repeated, now without anything to reject
    assert table.accepted().count() + table.rejected().count() == len(rows) + 1
    assert as_sets(table.accepted().select("id", "load_id")) == [(1, "one"), (1, "two"), (4, "one")]
    assert {r.load_id for r in table.rejected().collect()} == {"one"} and table.accepted().columns == [*df.columns, "load_id"]
