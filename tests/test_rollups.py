"""Cells and distinct parts beside the loaded star: what they answer, what they refuse, and how loads keep them."""

import datetime as dt
from functools import partial

import pytest
from pyspark.sql import functions as F

from conftest import as_sets

from starcellar.operational import Operational
from starcellar.plans import cube, loads, rollups
from starcellar.plans.loaded_warehouse import LoadedWarehouse
from starcellar.plans.rollups import Cells, Distinct, RolledWarehouse, keep_up
from starcellar.plans.star_load import StarLoad

MONEY = {"revenue": "revenue", "profit": "profit", "line_count": "lines"}
ORDERS = {"orders": "orders"}


@pytest.fixture(scope="module")
def star(tables):
    return loads.loaded_star(tables).store


def same_as_lines(store, **options):
    """Compare slices by several attributes, with counts, with those from the lines."""
    cells, lines = RolledWarehouse(store, strict=True, **options), LoadedWarehouse(store)
    for by, counts, filters in (
        (["YearNumber", "QuarterName", "Category"], ORDERS, None),
        (["Category"], ORDERS, {"YearNumber": [1995, 1996], "Category": ["PROMO", "SMALL"]}),
        (["MonthYear"], ORDERS, {"MonthNumber": [2, 6, 7]}),
        (["Brand", "YearNumber"], None, None),
    ):
        found, want = (cube.cube_slice(w, "sales", by, MONEY, counts, filters) for w in (cells, lines))
        assert found.columns == want.columns and as_sets(found) == as_sets(want) and want.count() > 0, by
        assert not any("/FactSales/" in f for f in found.inputFiles())
    counted = [as_sets(w.distinct_counts("sales", ["QuarterName", "Category"], ORDERS)) for w in (cells, lines)]
    assert counted[0] == counted[1]


def test_cells_answer_what_the_lines_do(star):
    same_as_lines(star)


@pytest.mark.parametrize("by, counts", [
    (["WeekNumber"], None),  # finer than a month
    (["Category", "CustomerCategory"], None),  # no cells hold both keys
    (["YearNumber"], {"products": "products"}),  # not additive, and no parts hold it
    (["Brand"], ORDERS),
])
def test_other_slices_are_refused_or_read_from_the_lines(star, by, counts):
    with pytest.raises(ValueError, match="no stored cells"):
        cube.cube_slice(RolledWarehouse(star, strict=True), "sales", by, MONEY, counts)
    found, want = (cube.cube_slice(w, "sales", by, MONEY, counts) for w in (RolledWarehouse(star), LoadedWarehouse(star)))
    assert as_sets(found) == as_sets(want)


def test_parts_of_months_are_refused(star):
    cells, lines = RolledWarehouse(star), LoadedWarehouse(star)
    for since, until in ((dt.date(1997, 2, 1), dt.date(1997, 5, 1)), (dt.date(1997, 2, 3), dt.date(1997, 5, 1))):
        found, want = (w.totals("sales", ["MonthNumber"], MONEY, since, until) for w in (cells, lines))
        assert as_sets(found) == as_sets(want)
        assert any("/FactSales/" in f for f in found.inputFiles()) == (since.day != 1)


def test_the_coarsest_cells_are_taken(star):
    w = RolledWarehouse(star)
    sums = w.facts["sales"].measures["revenue"].sums
    assert w.cells_for("sales", ["YearNumber"], sums).table == "SalesBySeller"
    assert w.cells_for("sales", ["ProductKey", "MonthNumber"], sums).table == "SalesByProduct"
    assert w.cells_for("sales", ["InvoiceID"], sums) is None


def test_loads_keep_cells_catch_up_and_relabel(tables, tmp_path, monkeypatch):
    kept = (Cells("ByProduct", "sales", ("ProductKey",)), Distinct("Orders", "sales", "orders", ()),
            Distinct("OrdersByCategory", "sales", "orders", ("Category",)))
    keep = (partial(keep_up, kept=kept),)
    half, most = dt.date(1996, 6, 14), dt.date(1998, 6, 30)
    first = StarLoad(Operational(tables), str(tmp_path), keep)
    first.load_dimensions()
    first.load_sales(until=half)
    same_as_lines(first.store, kept=kept)
    held = first.store.current().parts

    StarLoad(Operational(tables), str(tmp_path)).load_sales(until=most)  # a run that keeps no cells
    assert RolledWarehouse(first.store, kept=kept).kept == []
    with pytest.raises(ValueError, match="no stored cells"):
        cube.cube_slice(RolledWarehouse(first.store, strict=True, kept=kept), "sales", ["YearNumber"], MONEY)

    first.load_sales()  # catches up with both runs, in parts beside the first
    same_as_lines(first.store, kept=kept)
    now = first.store.current().parts
    assert all(now[k.table][0] == held[k.table][0] and len(now[k.table]) == 2 for k in kept)

    changed = tables.replaced(part=tables.read("part").withColumn(
        "p_type", F.when(F.col("p_partkey") % 4 == 0, F.lit("SMALL")).otherwise(F.col("p_type"))))
    relabelled = StarLoad(Operational(changed), str(tmp_path), keep)
    relabelled.load_dimensions()
    same_as_lines(first.store, kept=kept)
    after = first.store.current().parts
    assert len(after["OrdersByCategory"]) == 1 and all(after[t] == now[t] for t in ("ByProduct", "Orders"))

    monkeypatch.setattr(rollups, "MERGE_AT", 1)
    late = tables.replaced(orders=tables.read("orders").limit(50).withColumn(
        "o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 9 YEARS")).unionByName(tables.read("orders")))
    last = StarLoad(Operational(late.replaced(part=changed.read("part"))), str(tmp_path), keep)
    last.load_dimensions()
    last.load_sales()
    same_as_lines(first.store, kept=kept)
    assert all(len(first.store.current().parts[k.table]) == 1 for k in kept)


def test_ids_are_shuffled_and_not_their_bitmaps(star):
    """A bitmap of a few ids is as long as one of many, so each is made in one task."""
    for one in (k for k in rollups.KEPT if isinstance(k, Distinct)):
        rows = one.build(LoadedWarehouse(star))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.index("Exchange hashpartitioning")]  # a plan is printed from its end
        assert above.count("bitmap_construct_agg") > 0 and "bitmap_construct_agg" not in plan[len(above):], one.table
        groups = [c for c in rows.columns if c != rollups.BITS]
        assert rows.groupBy(*groups).count().filter("count > 1").count() == 0
