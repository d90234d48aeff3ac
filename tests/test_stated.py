"""Stock rebuilt from movements, and turnover over a period."""

import datetime as dt

from pyspark.sql import functions as F

from starcellar.plans import stated

FIRST, END = dt.date(1995, 1, 1), dt.date(2002, 1, 1)


def test_the_last_balance_is_the_present_stock(warehouse):
    last = stated.stock_by_day(warehouse, FIRST, END).groupBy("ProductKey").agg(
        F.max_by("balance", "FullDate").alias("balance"))
    rows = last.join(warehouse.stock(), "ProductKey")
    assert rows.count() == last.count() > 0 and rows.filter("balance <> CurrentStock").count() == 0


def test_balances_differ_by_what_moved(warehouse):
    rows = stated.stock_by_day(warehouse, dt.date(1997, 2, 10), dt.date(1997, 8, 5)).collect()
    by_product = {}
    for r in sorted(rows, key=lambda r: (r.ProductKey, r.FullDate)):
        before = by_product.get(r.ProductKey)
        assert before is None or r.balance - before == r.moved
        by_product[r.ProductKey] = r.balance
    assert rows and {r.FullDate.month for r in rows} == {2, 3, 4, 5, 6, 7, 8}


def test_stock_days_are_the_sum_of_the_days(warehouse):
    since, until = dt.date(1998, 3, 10), dt.date(1998, 4, 20)
    moved = {}
    for r in warehouse.star("movements", ["ProductKey", "MovementDate", "Quantity"]).collect():
        moved.setdefault(r.ProductKey, []).append((r.MovementDate, r.Quantity))
    stock = {r.ProductKey: r.CurrentStock for r in warehouse.stock().collect()}
    days = [since + dt.timedelta(n) for n in range((until - since).days)]
    want = {p: sum(s - sum(q for m, q in moved.get(p, ()) if m > d) for d in days) for p, s in stock.items()}
    assert {r.ProductKey: r.stock_days for r in stated.stock_days(warehouse, since, until).collect()} == want


def test_nothing_is_gathered_by_product_alone(warehouse):
    plan = stated.stock_days(warehouse, FIRST, END)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_supplier_measures(warehouse):
    top = stated.supplier_concentration(warehouse, 5).collect()
    shares = [r.spend_share for r in sorted(top, key=lambda r: r["rank"])]
    assert [r["rank"] for r in sorted(top, key=lambda r: r["rank"])] == list(range(1, len(top) + 1))
    assert shares == sorted(shares, reverse=True) and abs(sum(shares) - max(r.cumulative_share for r in top)) < 1e-9
    rows = stated.supplier_fulfilment(warehouse).collect()
    assert rows and all(0 <= r.share_in_time <= 1 for r in rows)
