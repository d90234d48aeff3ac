"""Loads of the given tables: cleaning, validation, dimensions, facts, upkeep, and round trips through files."""

from __future__ import annotations

import datetime as dt
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.functions.money import money_label
from starcellar.layout import Tables
from starcellar.operational import GIVEN_RULES, Operational
from starcellar.operators import clean, dimensions, facts, keys, upkeep
from starcellar.operators.constraints import constraint_report as report
from starcellar.operators.lookup import DROP, KEEP, lookup
from starcellar.session import scratch_path
from starcellar.sources.files import csv_source, limited_fetch
from starcellar.sources.sinks import WatermarkStore, append_sink, read_versioned, reload_sink, write_versioned
from starcellar.operators.as_of import as_of_lookup
from starcellar.operators.buckets import DELETE, INSERT, UPDATE, BucketedTable
from starcellar.operators.rejects import CheckedTable
from starcellar.schemas import Rules
from starcellar.sources.snapshots import Snapshots
from starcellar.plans.loaded_warehouse import LoadedWarehouse
from starcellar.plans.rollups import RolledWarehouse, keep_up
from starcellar.plans.star_load import StarLoad
from starcellar.streaming.sales import SalesStream, Side

MARK = dt.date(1998, 6, 30)
FIRST_LOAD, SECOND_LOAD = dt.date(2000, 1, 1), dt.date(2000, 2, 1)


def with_doubles(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, for comparison with other engines."""
    return df.select(
        *(F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
          for f in df.schema.fields)
    )


# Sources ---------------------------------------------------------------------------------------------


def table_source(t: Tables) -> DataFrame:
    """One join query over stored tables, as a load reads them."""
    orders = t.read("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    customers = t.read("customer").select("c_custkey", "c_name")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_name", "o_orderdate")


def csv_round_trip(t: Tables) -> DataFrame:
    """Orders written as an extract and read back with a declared schema."""
    path = scratch_path(t.spark, "extract")
    orders = t.read("orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"
    )
    orders.write.option("sep", ";").option("header", True).csv(path)
    return csv_source(t.spark, path, orders.schema)


def first_orders(t: Tables) -> DataFrame:
    """A bounded fetch of the latest orders."""
    orders = t.read("orders").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return limited_fetch(orders.select("o_orderkey", "o_custkey"), 100)


# Cleaning --------------------------------------------------------------------------------------------


def _raw_orders(t: Tables) -> DataFrame:
    """Orders as an extract might hold them: dates in two formats or unreadable, missing amounts as text."""
    day = F.col("o_orderdate")
    return t.read("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderstatus") == "F", F.date_format(day, "M/d/yyyy"))
        .otherwise("not a date").alias("OrderDate"),
        F.when(F.col("o_orderpriority") == "5-LOW", float("nan")).otherwise(F.col("o_totalprice")).alias("Amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "NULL").otherwise(F.col("o_orderpriority")).alias("Priority"),
    )


def clean_values(t: Tables) -> DataFrame:
    return clean.clean_values(_raw_orders(t))


def project_rename(t: Tables) -> DataFrame:
    return clean.project_rename(
        t.read("customer"), {"c_custkey": "CustomerID", "c_name": "CustomerName", "c_nationkey": "CityID"}
    )


def employee_filter(t: Tables) -> DataFrame:
    people = clean.employee_filter(Operational(t).people())
    return clean.project_rename(people, clean.CONFORMED["Employees"])


def _item_groups(t: Tables) -> DataFrame:
    """Products and the suppliers they were bought from, in the shape of items and their groups."""
    return t.read("lineitem").select(F.col("l_partkey").alias("StockItemID"), F.col("l_suppkey").alias("StockGroupID"))


def first_category(t: Tables) -> DataFrame:
    return clean.first_category(_item_groups(t))


def product_conform(t: Tables) -> DataFrame:
    items = t.read("part").select(F.col("p_partkey").alias("StockItemID"), F.col("p_name").alias("StockItemName"))
    return clean.product_conform(items, _item_groups(t))


def order_line_amounts(t: Tables) -> DataFrame:
    op = Operational(t)
    return with_doubles(clean.order_line_amounts(op.priced_lines(), op.costs()).drop("LastCostPrice"))


def constraint_report(t: Tables) -> DataFrame:
    return report({name: t.read(name) for name in GIVEN_RULES}, GIVEN_RULES)


def cast_columns(t: Tables) -> DataFrame:
    days = Operational(t).dim_date().select("DateKey", "FullDate", "MonthName", "QuarterName", "YearNumber")
    return clean.cast_columns(days, ["FullDate"], ["YearNumber"])


def dedupe(t: Tables) -> DataFrame:
    """One product per name, the one with the smallest key."""
    parts = t.read("part").select("p_name", "p_partkey", "p_brand")
    return clean.dedupe(parts, ["p_name"], ["p_partkey"])


# Dimensions and facts --------------------------------------------------------------------------------


def dim_date(t: Tables) -> DataFrame:
    return Operational(t).dim_date()


def fixed_calendar(t: Tables) -> DataFrame:
    """The orders' days that a fixed calendar of some years does not cover, by year."""
    covered = dimensions.fixed_calendar("1996-03-01", "1998-12-31", t.spark).select("FullDate")
    days = t.order_heads().groupBy(F.col("OrderDate").alias("FullDate")).agg(F.count(F.lit(1)).alias("orders"))
    missing = days.join(covered, "FullDate", "left_anti")
    return missing.groupBy(F.year("FullDate").alias("YearNumber")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders")
    )


def dim_location(t: Tables) -> DataFrame:
    return Operational(t).dim_location()


def dim_customer(t: Tables) -> DataFrame:
    return Operational(t).dim_customer()


def dim_supplier(t: Tables) -> DataFrame:
    return Operational(t).dim_supplier()


def dim_product(t: Tables) -> DataFrame:
    return with_doubles(Operational(t).dim_product())


def dim_employee(t: Tables) -> DataFrame:
    return dimensions.dim_employee(employee_filter(t))


@cache
def _loaded_root(application: str, spark: SparkSession, folder: str) -> str:
    """The star of a folder, loaded up to the mark, then with the rest; once a session."""
    load = StarLoad(Operational(Tables(spark, folder)), scratch_path(spark, "star"), (keep_up,))
    load.load(until=MARK)
    load.load()
    return load.root


def loaded_star(t: Tables) -> StarLoad:
    return StarLoad(Operational(t), _loaded_root(t.spark.sparkContext.applicationId, t.spark, t.folder))


def loaded_warehouse(t: Tables) -> LoadedWarehouse:
    return LoadedWarehouse(loaded_star(t).store)


def rolled_warehouse(t: Tables) -> RolledWarehouse:
    """The loaded star, answering from its monthly cells and distinct parts alone."""
    return RolledWarehouse(loaded_star(t).store, strict=True)


def loaded_sales(t: Tables) -> DataFrame:
    """Sales of the loaded star by natural keys."""
    return with_doubles(loaded_star(t).by_natural_keys("FactSales").drop("ProductSince"))


def loaded_purchases(t: Tables) -> DataFrame:
    return with_doubles(loaded_star(t).by_natural_keys("FactPurchases").drop("LineCost"))


def loaded_movements(t: Tables) -> DataFrame:
    return loaded_star(t).by_natural_keys("FactInventoryTransactions")


def loaded_payments(t: Tables) -> DataFrame:
    return with_doubles(loaded_star(t).by_natural_keys("FactFinancialTransactions").drop("TransactionDate"))


def loaded_stock(t: Tables) -> DataFrame:
    return with_doubles(loaded_star(t).by_natural_keys("FactInventory"))


def dim_delivery_method(t: Tables) -> DataFrame:
    return dimensions.dim_delivery_method(Operational(t).delivery_methods())


def dim_transaction_type(t: Tables) -> DataFrame:
    return dimensions.dim_transaction_type(Operational(t).transaction_types())


def dim_payment_method(t: Tables) -> DataFrame:
    return dimensions.dim_payment_method(Operational(t).payment_methods())


def surrogate_key(t: Tables) -> DataFrame:
    """Keys after two loads, the second with one more segment: by segment, whether a key was given before and stayed."""
    customers = t.read("customer")
    first = keys.surrogate_key(customers.filter("c_mktsegment <> 'BUILDING'"), "c_custkey", "FirstKey")
    both = keys.surrogate_key(
        customers, "c_custkey", "CustomerKey", assigned=first.withColumnRenamed("FirstKey", "CustomerKey"))
    known = customers.select("c_custkey", "c_mktsegment").join(both, "c_custkey").join(first, "c_custkey", "left")
    before = first.agg(F.max("FirstKey")).scalar()
    return known.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("CustomerKey").alias("distinct_keys"),
        F.count_if(F.col("FirstKey") == F.col("CustomerKey")).alias("stayed"),
        F.count_if(F.col("CustomerKey") > before).alias("added"),
    )


def lookup_drop(t: Tables) -> DataFrame:
    """Purchase lines whose expected date is in the calendar, by supplier."""
    lines = Operational(t).purchase_details().select("SupplierID", "ExpectedDeliveryDate")
    found = lookup(lines, Operational(t).dim_date(), {"ExpectedDeliveryDate": "FullDate"}, {"DateKey": "DateKey"}, DROP)
    return found.groupBy("SupplierID").agg(F.count(F.lit(1)).alias("lines"), F.max("DateKey").alias("last_key"))


def lookup_keep(t: Tables) -> DataFrame:
    """All purchase lines, by the month of their expected date where the calendar has it."""
    lines = Operational(t).purchase_details().select("ExpectedDeliveryDate")
    found = lookup(
        lines, Operational(t).dim_date(), {"ExpectedDeliveryDate": "FullDate"}, {"MonthYear": "MonthYear"}, KEEP
    )
    return found.groupBy("MonthYear").agg(F.count(F.lit(1)).alias("lines"))


def _fact_sales(op: Operational, invoices: DataFrame) -> DataFrame:
    return facts.fact_sales(invoices, op.invoice_details(), op.dims())


def fact_sales(t: Tables) -> DataFrame:
    op = Operational(t)
    return with_doubles(_fact_sales(op, op.invoices()))


def _purchase_rows(op: Operational, orders: DataFrame) -> DataFrame:
    rows = facts.fact_purchases(op.purchase_details().join(orders, "PurchaseOrderID"), op.dims())
    return with_doubles(rows)


def fact_purchases(t: Tables) -> DataFrame:
    op = Operational(t)
    return _purchase_rows(op, op.purchase_orders())


def fact_inventory(t: Tables) -> DataFrame:
    op = Operational(t)
    return with_doubles(facts.fact_inventory(op.inventory(), op.dims()))


def fact_inventory_transactions(t: Tables) -> DataFrame:
    op = Operational(t)
    return facts.fact_inventory_transactions(op.inventory_transactions(), op.dims())


def fact_financial(t: Tables) -> DataFrame:
    return with_doubles(facts.fact_financial(t.customer_payments(), t.supplier_payments(), Operational(t).dims()))


# Incremental loads -----------------------------------------------------------------------------------


def incremental_fact(t: Tables, mark: dt.date = MARK) -> DataFrame:
    """Sales after the mark."""
    op = Operational(t)
    newer = facts.newer_rows(op.invoices(), "InvoiceDate", mark)
    return with_doubles(facts.fact_sales(newer, op.invoice_details(newer), op.dims()))


def incremental_purchases(t: Tables, mark: dt.date = MARK) -> DataFrame:
    """Purchases ordered after the mark."""
    op = Operational(t)
    return _purchase_rows(op, facts.newer_rows(op.purchase_orders(), "PurchaseOrderDate", mark))


def incremental_movements(t: Tables, mark: dt.date = MARK) -> DataFrame:
    """Stock movements after the mark."""
    op = Operational(t)
    newer = facts.newer_rows(op.inventory_transactions(), "TransactionDate", mark)
    return facts.fact_inventory_transactions(newer, op.dims())


def incremental_with_lookback(t: Tables, mark: dt.date = MARK, days: int = 7) -> DataFrame:
    """Sales after the mark, and invoices of the week before it that an earlier load missed.

    The earlier load is taken to have missed the invoices of urgent orders on its last day.
    """
    op = Operational(t)
    missed = (F.col("InvoiceDate") == F.lit(mark)) & (F.col("EmployeeID") == "1-URGENT")
    in_window = (F.col("InvoiceDate") <= F.lit(mark)) & (F.col("InvoiceDate") > F.date_sub(F.lit(mark), days))
    loaded = op.invoices().filter(in_window & ~missed)
    newer = facts.newer_rows(op.invoices(), "InvoiceDate", mark)
    late = facts.late_rows(op.invoices(), "InvoiceDate", mark, days, loaded, "InvoiceID")
    return with_doubles(_fact_sales(op, newer.unionByName(late)))


# Upkeep ----------------------------------------------------------------------------------------------


def _stock_before(t: Tables) -> DataFrame:
    """An earlier stock: without promotional products, and with more of every large one."""
    names = t.read("part").select(F.col("p_partkey").alias("ProductKey"), "p_type", "p_size")
    earlier = F.col("CurrentStock") + F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)
    rows = t.stock().join(names, "ProductKey").filter("p_type <> 'PROMO'")
    return rows.withColumn("CurrentStock", earlier.cast("int")).drop("p_type", "p_size")


def _stock_now(t: Tables) -> DataFrame:
    """The present stock, without economy products."""
    kept = t.read("part").filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("ProductKey"))
    return t.stock().join(kept, "ProductKey", "left_semi")


def upsert_inventory(t: Tables) -> DataFrame:
    return with_doubles(upkeep.upsert_inventory(_stock_before(t), _stock_now(t)))


def change_set(t: Tables) -> DataFrame:
    return upkeep.change_set(_stock_before(t), _stock_now(t), "ProductKey", upkeep.INVENTORY_COLUMNS)


def dim_history(t: Tables) -> DataFrame:
    """Versions of the stock levels after two loads."""
    columns = ("CurrentStock", "ReorderLevel")
    first = upkeep.first_history(_stock_before(t).select("ProductKey", *columns), FIRST_LOAD)
    return upkeep.dim_history(first, _stock_now(t), "ProductKey", columns, SECOND_LOAD)


def current_rows(t: Tables) -> DataFrame:
    return upkeep.current_rows(dim_history(t)).select("ProductKey", "CurrentStock", "validFrom")


def history_lookup(t: Tables) -> DataFrame:
    """Sales lines with the version of their product's stock levels that was valid on the invoice's day, by year and version."""
    lines = t.order_lines().join(t.order_heads().select("OrderKey", "OrderDate"), "OrderKey")
    versions = dim_history(t).select("ProductKey", "validFrom", "CurrentStock", "ReorderLevel")
    valid = as_of_lookup(
        lines.select("ProductKey", "OrderDate", "Quantity"), versions.withColumn("since", F.col("validFrom")),
        "ProductKey", "OrderDate", "since", ["validFrom", "CurrentStock", "ReorderLevel"])
    return valid.groupBy(F.year("OrderDate").alias("YearNumber"), "validFrom").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Quantity").cast("bigint").alias("quantity"),
        F.sum("CurrentStock").cast("bigint").alias("stock"), F.sum("ReorderLevel").cast("bigint").alias("reorder"))


# Files -----------------------------------------------------------------------------------------------


def append_twice(t: Tables) -> DataFrame:
    """Sales up to the mark stored, the rest appended, and the whole read back by month."""
    path = scratch_path(t.spark, "fact-sales")
    op = Operational(t)
    load = partial(_fact_sales, op)
    append_sink(load(op.invoices().filter(F.col("InvoiceDate") <= F.lit(MARK))), path)
    append_sink(load(facts.newer_rows(op.invoices(), "InvoiceDate", MARK)), path)
    return _by_month(t.spark.read.parquet(path))


def _by_month(sales: DataFrame) -> DataFrame:
    month = F.floor(F.col("InvoiceDateKey") / 100).cast("int").alias("month")
    return with_doubles(
        sales.groupBy(month).agg(F.count(F.lit(1)).alias("line_count"), F.sum("LineTotal").alias("revenue"))
    )


def reload_year(t: Tables) -> DataFrame:
    """Orders stored by year, then one year replaced by its urgent orders only; the other years stay."""
    path = scratch_path(t.spark, "orders")
    orders = t.order_heads().select("OrderKey", "EmployeeKey", F.year("OrderDate").alias("YearNumber"))
    reload_sink(orders, path, ("YearNumber",))
    urgent = orders.filter("YearNumber = 1998 AND EmployeeKey = '1-URGENT'")
    reload_sink(urgent, path, ("YearNumber",), only_partitions=True)
    return t.spark.read.parquet(path).groupBy("YearNumber", "EmployeeKey").agg(F.count(F.lit(1)).alias("orders"))


def watermarks(t: Tables) -> DataFrame:
    """The load log after loads up to the mark and after the rest."""
    store = WatermarkStore(t.spark, scratch_path(t.spark, "load-log"))
    days = t.order_heads().select("OrderDate")
    store.advance("FactSales", days.filter(F.col("OrderDate") <= F.lit(MARK)))
    store.advance("FactPurchases", days)
    store.advance("FactSales", facts.newer_rows(days, "OrderDate", store.read("FactSales")))
    store.advance("FactInventoryTransactions", days.filter(F.col("OrderDate") <= F.lit(MARK)))
    return store.table()


def stored_upsert(t: Tables) -> DataFrame:
    """The stock table after its upsert was written as a new version beside the old one."""
    root = scratch_path(t.spark, "stock")
    write_versioned(_stock_before(t), root)
    write_versioned(upkeep.upsert_inventory(read_versioned(t.spark, root), _stock_now(t)), root)
    return with_doubles(read_versioned(t.spark, root))


def bucketed_upsert(t: Tables) -> DataFrame:
    """The stock table after its upsert rewrote the buckets with changes."""
    table = BucketedTable(Snapshots(t.spark, scratch_path(t.spark, "stock")), "stock", "ProductKey", upkeep.INVENTORY_COLUMNS)
    table.upsert(_stock_before(t))
    table.upsert(_stock_now(t))
    return with_doubles(table.read())


def customer_events(t: Tables) -> DataFrame:
    """Each order as an event of its customer: processing ones insert, open ones update, filled ones delete."""
    kind = F.when(F.col("o_orderstatus") == "F", DELETE).when(F.col("o_orderstatus") == "P", INSERT).otherwise(UPDATE)
    return t.read("orders").select(
        F.col("o_custkey").alias("CustomerID"), kind.alias("operation"), F.col("o_orderkey").alias("sequence"),
        F.col("o_orderpriority").alias("Priority"), F.col("o_totalprice").alias("Amount"))


def change_feed(t: Tables, runs: int = 3) -> DataFrame:
    """The last state of each customer after its events came in runs in no order."""
    table = BucketedTable(Snapshots(t.spark, scratch_path(t.spark, "feed")), "customers", "CustomerID", ("Priority", "Amount"))
    events = customer_events(t)
    for n in range(runs):
        table.apply(events.filter(F.pmod(F.xxhash64("sequence"), F.lit(runs)) == n), "operation", "sequence")
    return table.read()


def append_with_rejects(t: Tables) -> DataFrame:
    """Lines checked as they are appended in two loads, the second run twice: rows by load and by the rules they break."""
    rules = Rules("l_orderkey", ("l_partkey", "l_quantity"),
                  {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey")},
                  {"quantity_above_5": "l_quantity > 5"}, {"l_returnflag": 1})
    parents = {"orders": t.read("orders").filter("o_orderdate >= timestamp'1996-01-01'"),
               "part": t.read("part").filter("p_size <= 40")}
    lines = t.read("lineitem")
    only = lines.groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"),
                                           F.max("l_returnflag").alias("l_returnflag"))
    table = CheckedTable(t.spark, scratch_path(t.spark, "checked"), rules)
    table.append(lines.select(only.columns), "lines", parents)
    for _ in range(2):
        table.append(only, "orders", parents)
    rows = table.accepted().select("load_id", F.lit("").alias("reasons")).unionByName(
        table.rejected().select("load_id", F.array_join("reasons", "; ").alias("reasons")))
    return rows.groupBy("load_id", "reasons").agg(F.count(F.lit(1)).alias("row_total"))


def sales_stream(t: Tables, load: StarLoad, root: str) -> SalesStream:
    """The sales of a folder as two streams, with the keys of a loaded star."""
    # What is not read of an invoice does not wait in state for its lines either.
    orders = t.read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = t.read("lineitem")

    def to_fact(joined: DataFrame) -> DataFrame:
        batch = t.replaced(lineitem=joined.select(*lines.columns, "o_orderdate", "o_custkey", "o_orderpriority"))
        priced = Operational(batch).invoice_details(also=("o_orderdate", "o_custkey", "o_orderpriority", "LineID"))
        heads = priced.withColumnsRenamed({"o_custkey": "CustomerID", "o_orderpriority": "EmployeeID"})
        dated = heads.withColumn("InvoiceDate", F.col("o_orderdate").cast("date")).drop("o_orderdate")
        return facts.sales_of_lines(dated, load.dims(), ("LineID",))

    return SalesStream(
        Side(f"{t.folder}/orders.parquet", orders.schema, "o_orderkey", ("o_orderkey",)),
        Side(f"{t.folder}/lineitem.parquet", lines.schema, "l_orderkey", tuple(lines.columns)),
        to_fact, ("InvoiceID", "LineID"), f"{root}/sales", f"{root}/late", f"{root}/checkpoint")


def stream_fact_sales(t: Tables) -> DataFrame:
    """The sales fact loaded as streams of invoice files and line files, by month."""
    stream = sales_stream(t, loaded_star(t), scratch_path(t.spark, "stream"))
    stream.run(t.spark)
    return _by_month(t.spark.read.parquet(stream.output))


# Labels ----------------------------------------------------------------------------------------------


def money_labels(t: Tables) -> DataFrame:
    """Sales by customer segment and order priority as printed labels."""
    totals = t.order_heads().join(t.customers(), "CustomerKey").groupBy("CustomerCategory", "EmployeeKey").agg(
        F.sum("OrderAmount").alias("amount"), F.max("OrderAmount").alias("largest")
    )
    return totals.select(
        "CustomerCategory", "EmployeeKey", money_label(F.col("amount")).alias("total"),
        money_label(F.col("largest")).alias("largest"),
    )
