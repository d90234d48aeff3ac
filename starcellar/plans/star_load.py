"""The load of the whole star: dimensions, facts, stock and marks, which readers see change at once.

A run reads the snapshot it starts from, writes new versions of the dimensions and parts with the rows dated after each
fact's mark, looks keys up in the new dimensions, checks the parts, and publishes everything in one manifest.  A run
that dies anywhere leaves the snapshot as it was, and what it wrote is never named, so it is simply repeated.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starcellar.functions.calendar import date_key
from starcellar.operational import Dims, Operational
from starcellar.operators import dimensions, facts
from starcellar.operators.as_of import as_of_lookup
from starcellar.operators.constraints import row_violations
from starcellar.operators.keys import surrogate_key
from starcellar.operators.lookup import LIST_ROWS, short_list
from starcellar.operators.upkeep import current_rows, dim_history, first_history, upsert_inventory
from starcellar.schemas import Rules
from starcellar.session import CODEC, RUN_SETTINGS, settings
from starcellar.sources.snapshots import Snapshot, Snapshots

# Dimension: natural key, surrogate key, and whether it is a short list that is sent to every task.
DIMENSIONS = {
    "DimProduct": ("ProductID", "ProductKey", False),
    "DimCustomer": ("CustomerID", "CustomerKey", False),
    "DimSupplier": ("SupplierID", "SupplierKey", False),
    "DimEmployee": ("EmployeeID", "EmployeeKey", True),
    "DimDeliveryMethod": ("DeliveryMethodID", "DeliveryMethodKey", True),
    "DimTransactionType": ("TransactionTypeID", "TransactionTypeKey", True),
    "DimPaymentMethod": ("PaymentMethodID", "PaymentMethodKey", True),
}
# Dimensions whose versions are kept: the table of versions, and the attributes that make a new one.
HISTORIES = {"DimProduct": ("DimProductHistory", ("Product", "Category", "Color", "Brand", "LastCostPrice"))}
ALWAYS = dt.date(1900, 1, 1)  # the first version of a member is valid from here
WRITERS = 4  # tables that a run writes at a time
YEAR = "LoadYear"


@dataclass(frozen=True)
class FactLoad:
    """``day``: the column a fact's mark follows, a date or a date key; ``document``: what a late row is known by."""

    day: str
    keys: dict[str, str]
    rules: Rules

    def date(self) -> Column:
        if not self.day.endswith("Key"):
            return F.col(self.day)
        key = F.col(self.day)
        return F.make_date(F.floor(key / 10000).cast("int"), F.floor(key / 100).cast("int") % 100, key % 100)


FACT_LOADS = {
    "FactSales": FactLoad(
        "InvoiceDateKey",
        {"ProductKey": "DimProduct", "CustomerKey": "DimCustomer", "EmployeeKey": "DimEmployee",
         "DeliveryMethodKey": "DimDeliveryMethod"},
        Rules("InvoiceID", ("InvoiceDateKey", "ProductKey", "CustomerKey", "EmployeeKey", "DeliveryMethodKey"),
              checks={"quantity_positive": "Quantity > 0"}),
    ),
    "FactPurchases": FactLoad(
        "PurchaseDateKey",
        {"ProductKey": "DimProduct", "SupplierKey": "DimSupplier", "DeliveryMethodKey": "DimDeliveryMethod"},
        Rules("PurchaseOrderID", ("PurchaseDateKey", "ExpectedDeliveryDateKey", "ProductKey", "SupplierKey"),
              checks={"quantity_positive": "QuantityOrdered > 0"}),
    ),
    "FactInventoryTransactions": FactLoad(
        "DateKey", {"ProductKey": "DimProduct", "TransactionTypeKey": "DimTransactionType"},
        Rules("InvoiceID", ("DateKey", "ProductKey", "TransactionTypeKey"), checks={"quantity_given": "Quantity <> 0"}),
    ),
    "FactFinancialTransactions": FactLoad(
        "TransactionDate",
        {"CustomerKey": "DimCustomer", "SupplierKey": "DimSupplier", "PaymentMethodKey": "DimPaymentMethod",
         "TransactionTypeKey": "DimTransactionType"},
        Rules("InvoiceID", ("TransactionDate", "TransactionSource"), checks={"amount_not_negative": "TransactionAmount >= 0"}),
    ),
}


class Marks:
    def __init__(self, store: Snapshots):
        self.store = store

    def read(self, table: str) -> dt.date | None:
        return self.store.current().marks.get(table)


class Draft:
    """A snapshot in the making: what a run has written so far on top of the one it began from."""

    def __init__(self, store: Snapshots, base: Snapshot):
        self.store, self.base = store, base
        self.snapshot = replace(base, number=base.number + 1, parts=dict(base.parts), schemas=dict(base.schemas),
                                marks=dict(base.marks))
        self.added: dict[str, str] = {}

    def put(self, table: str, df: DataFrame, keep: bool = False, partition_by: tuple[str, ...] = (),
            codec: str | None = None) -> None:
        """Write a part that takes the place of the table's parts, or with ``keep`` stands beside them."""
        part = self.store.write(df, table, partition_by, codec)
        before = self.snapshot.parts.get(table, ()) if keep else ()
        schema = StructType([*df.schema.fields, StructField("part", StringType())])
        self.snapshot.parts[table], self.snapshot.schemas[table] = (*before, part), schema.json()
        self.added[table] = part

    def withdraw(self, table: str) -> None:
        """Leave the part just added out."""
        self.snapshot.parts[table] = tuple(p for p in self.snapshot.parts[table] if p != self.added[table])

    def read(self, table: str) -> DataFrame:
        return self.store.read(table, self.snapshot).drop("part")

    def read_added(self, table: str) -> DataFrame:
        return self.store.read(table, replace(self.snapshot, parts={table: (self.added[table],)})).drop("part")

    def publish(self) -> Snapshot:
        return self.store.publish(self.snapshot)


def together(jobs: Iterable[Callable[[], None]]) -> None:
    """Run writes that do not need each other side by side; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(WRITERS) as pool:
        running = [pool.submit(job) for job in jobs]
    for job in running:
        job.result()


def in_turn(jobs: Iterable[Callable[[], None]]) -> Callable[[], None]:
    """One job that runs these one after the other: writes of long tables, one of which keeps a cluster busy, so that the
    shuffle files of several never lie on disk beside each other."""
    def run() -> None:
        for job in jobs:
            job()

    return run


class StarLoad:
    """``derived`` bring tables made from others up to date in each run, before it is published."""

    def __init__(self, source: Operational, root: str, derived: Sequence[Callable[[Draft], None]] = ()):
        self.source, self.root, self.derived = source, root, derived
        self.spark = source.tables.spark
        self.store = Snapshots(self.spark, root)
        self.marks = Marks(self.store)
        self._draft: Draft | None = None

    def draft(self) -> Draft:
        return Draft(self.store, self.store.current())

    def load(self, until: dt.date | None = None, lookback_days: int = 0, since: dt.date | None = None) -> Snapshot:
        """One run over everything: rows dated after each fact's mark, up to ``until`` if given.

        ``lookback_days`` adds documents of the days before the mark that earlier runs did not have.  Attributes that
        changed are valid ``since`` the day after the last sale loaded before, if not given.
        """
        with settings(self.spark, RUN_SETTINGS):
            draft = self.draft()
            self._write_dimensions(draft, since)
            dims = self.dims(draft)
            facts_ = in_turn([lambda name=name: self._write_fact(draft, name, dims, until, lookback_days) for name in FACT_LOADS])
            together([facts_, lambda: self._write_stock(draft, dims)])
            self._check(draft, FACT_LOADS)
            return self._publish(draft)

    def _publish(self, draft: Draft) -> Snapshot:
        for bring in self.derived:
            bring(draft)
        return draft.publish()

    # Dimensions ----------------------------------------------------------------------------------

    def _members(self) -> dict[str, DataFrame]:
        op = self.source
        return {
            "DimProduct": op.dim_product(), "DimCustomer": op.dim_customer(), "DimSupplier": op.dim_supplier(),
            "DimEmployee": dimensions.dim_employee(op.salespeople()),
            "DimDeliveryMethod": dimensions.dim_delivery_method(op.delivery_methods()),
            "DimTransactionType": dimensions.dim_transaction_type(op.transaction_types()),
            "DimPaymentMethod": dimensions.dim_payment_method(op.payment_methods()),
        }

    def load_dimensions(self) -> None:
        """New versions of all dimensions, without facts."""
        with settings(self.spark, RUN_SETTINGS):
            draft = self.draft()
            self._write_dimensions(draft)
            self._publish(draft)

    def _write_dimensions(self, draft: Draft, since: dt.date | None = None) -> None:
        """Write a new version of each dimension.

        Members known before keep their key and get their present attributes; new ones are numbered after them; those
        that the source no longer has stay as rows that are not current, as facts may still name them.
        """
        def write(name: str, members: DataFrame) -> None:
            natural, key, _ = DIMENSIONS[name]
            before = draft.read(name) if name in draft.base.parts else None
            given = surrogate_key(members, natural, key, None if before is None else before.select(natural, key))
            rows = members.join(given, natural).withColumn("isCurrent", F.lit(True))
            if before is not None:
                gone = before.join(members.select(natural), natural, "left_anti").withColumn("isCurrent", F.lit(False))
                rows = rows.unionByName(gone)
            draft.put(name, rows)

        op = self.source
        together([
            *(lambda n=name, m=members: write(n, m) for name, members in self._members().items()),
            lambda: draft.put("DimDate", op.dim_date()), lambda: draft.put("DimLocation", op.keyed_locations()),
        ])
        mark = draft.base.marks.get("FactSales")
        day = since or (mark + dt.timedelta(1) if mark else ALWAYS)
        for name, (table, columns) in HISTORIES.items():
            key = DIMENSIONS[name][1]
            members = draft.read(name).filter("isCurrent").select(key, *columns)
            draft.put(table, dim_history(draft.read(table), members, key, columns, day) if table in draft.base.parts
                      else first_history(members, ALWAYS))

    def dimension(self, name: str, draft: Draft | None = None) -> DataFrame:
        """The current rows of a stored dimension."""
        rows = draft.read(name) if draft else self.table(name)
        return current_rows(rows) if "isCurrent" in rows.columns else rows

    def dims(self, draft: Draft | None = None) -> Dims:
        """The stored dimensions as a load looks keys up in them; short lists are sent to every task."""
        draft = draft or self.draft()

        def keyed(name: str) -> DataFrame:
            natural, key, listed = DIMENSIONS[name]
            rows = self.dimension(name, draft).select(natural, key)
            return short_list(rows, LIST_ROWS) if listed else rows

        makers = {name: (lambda name=name: keyed(name)) for name in DIMENSIONS}
        return Dims({**makers, "DimDate": lambda: self.dimension("DimDate", draft).select("DateKey", "FullDate")})

    # Facts ---------------------------------------------------------------------------------------

    def _new(self, draft: Draft, rows: DataFrame, date: str, table: str, key: str, until: dt.date | None,
             lookback_days: int, of: Column | None = None) -> DataFrame:
        """Source rows after the mark, and those of the days before it whose document the fact does not have."""
        mark, day = draft.base.marks.get(table), F.col(date).cast("date")
        newer = rows if mark is None else rows.filter(day > F.lit(mark))
        newer = newer if until is None else newer.filter(day <= F.lit(until))
        if mark is None or lookback_days <= 0:
            return newer
        spec, first = FACT_LOADS[table], mark - dt.timedelta(lookback_days)
        own = F.col(spec.day) if spec.day == "TransactionDate" else F.col(spec.day).cast("int")
        from_day = F.lit(first) if spec.day == "TransactionDate" else date_key(F.lit(first))
        loaded = draft.store.read(table, draft.base).filter((F.col(YEAR) >= first.year) & (own >= from_day))
        loaded = loaded if of is None else loaded.filter(of)
        dated = rows.withColumn("_day", day)
        late = facts.late_rows(dated, "_day", mark, lookback_days, loaded, key).drop("_day")
        return newer.unionByName(late)

    def _rows(self, draft: Draft, name: str, dims: Dims, until: dt.date | None, lookback_days: int) -> DataFrame:
        op = self.source
        new = lambda rows, date, key, of=None: self._new(draft, rows, date, name, key, until, lookback_days, of)
        if name == "FactSales":
            heads = facts.invoice_keys(new(op.invoices(), "InvoiceDate", "InvoiceID"), dims)
            lines = op.invoice_details(heads=heads.select(
                "InvoiceID", "InvoiceDate", "InvoiceDateKey", "EmployeeKey", "CustomerKey"))
            # Costs, versions and keys of products are all found by the same column, so lines are dealt by it once.
            table, _ = HISTORIES["DimProduct"]
            versions = draft.read(table).select("ProductKey", "validFrom", F.col("validFrom").alias("ProductSince"))
            versions = versions.join(dims["DimProduct"], "ProductKey")
            dated = as_of_lookup(lines, versions, "ProductID", "InvoiceDate", "validFrom", ["ProductSince"])
            return facts.sales_of_keyed(dated, dims, ("ProductSince",))
        if name == "FactPurchases":
            orders = new(op.purchase_orders(), "PurchaseOrderDate", "PurchaseOrderID")
            return facts.fact_purchases(op.purchase_details().join(orders, "PurchaseOrderID"), dims, ("LineCost",))
        if name == "FactInventoryTransactions":
            return facts.fact_inventory_transactions(new(op.inventory_transactions(), "TransactionDate", "InvoiceID"), dims)
        source = F.col("TransactionSource")
        paid_in = new(op.tables.customer_payments(), "TransactionDate", "InvoiceID", source == "Customer")
        paid_out = new(op.tables.supplier_payments(), "TransactionDate", "PurchaseOrderID", source == "Supplier")
        return facts.fact_financial(paid_in, paid_out, dims, ("TransactionDate",))

    def _write_fact(self, draft: Draft, name: str, dims: Dims, until: dt.date | None, lookback_days: int = 0) -> None:
        rows = self._rows(draft, name, dims, until, lookback_days)
        # Rows are not shuffled once more by year: a task writes a file for each year it has rows of.
        rows = rows.withColumn(YEAR, F.year(FACT_LOADS[name].date()))
        draft.put(name, rows, keep=True, partition_by=(YEAR,), codec=CODEC)

    def _write_stock(self, draft: Draft, dims: Dims) -> None:
        """The stock after an upsert; products that the source no longer has keep theirs."""
        rows = facts.fact_inventory(self.source.inventory(), dims)
        before = draft.read("FactInventory") if "FactInventory" in draft.base.parts else None
        draft.put("FactInventory", rows if before is None else upsert_inventory(before, rows))

    def _check(self, draft: Draft, names: Iterable[str]) -> None:
        """Count the rules over the parts just written, and move the marks to their latest dates; empty parts go."""
        broken = []
        for name in names:
            rows, spec = draft.read_added(name), FACT_LOADS[name]
            broken += [r for r in row_violations(rows, name, spec.rules).collect() if r.violations]
            latest = rows.agg(F.count("*").alias("rows"), F.max(spec.date()).alias("day")).first()
            if not latest["rows"]:
                draft.withdraw(name)
            elif latest["day"] is not None:
                draft.snapshot.marks[name] = max(latest["day"], draft.base.marks.get(name, latest["day"]))
        if broken:
            raise ValueError("; ".join(
                f"{r.table_name}.{r.column_name} {r.rule}: {r.violations} rows" for r in broken))

    # Sales alone ---------------------------------------------------------------------------------

    def load_sales(self, until: dt.date | None = None) -> dt.date | None:
        """Load the invoices dated after the mark, up to ``until`` if given, and return the new mark."""
        return self.move_mark(self.append_sales(until))

    def append_sales(self, until: dt.date | None = None) -> dt.date | None:
        """Write the sales after the mark, which nobody sees yet, and return the mark the run began at."""
        self._draft = self.draft()
        with settings(self.spark, RUN_SETTINGS):
            self._write_fact(self._draft, "FactSales", self.dims(self._draft), until)
        return self._draft.base.marks.get("FactSales")

    def move_mark(self, began: dt.date | None) -> dt.date | None:
        """Check the sales just written and show them together with their mark; it stays if there are none."""
        draft, self._draft = self._draft, None
        if draft is None or draft.base.marks.get("FactSales") != began:
            raise ValueError("no sales were written from this mark")
        with settings(self.spark, RUN_SETTINGS):
            self._check(draft, ["FactSales"])
            return self._publish(draft).marks.get("FactSales")

    # Reading -------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """A table of the present snapshot."""
        return self.store.read(name, self.store.current()).drop("part")

    def sales(self) -> DataFrame:
        return self.table("FactSales")

    def by_natural_keys(self, name: str) -> DataFrame:
        """A stored fact with natural keys in place of surrogate keys, those of members gone since included."""
        snapshot = self.store.current()
        rows = self.store.read(name, snapshot).drop("part", YEAR)
        keys = FACT_LOADS[name].keys if name in FACT_LOADS else {"ProductKey": "DimProduct"}
        for key, dim in keys.items():
            natural, _, listed = DIMENSIONS[dim]
            known = self.store.read(dim, snapshot).select(F.col(key), F.col(natural).alias("natural"))
            rows = rows.join(short_list(known) if listed else known, key, "left").drop(key).withColumnRenamed("natural", key)
        return rows

    def sales_by_natural_keys(self) -> DataFrame:
        return self.by_natural_keys("FactSales")
