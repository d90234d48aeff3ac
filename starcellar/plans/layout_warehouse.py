"""The star over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.layout import Tables
from starcellar.operational import Operational
from starcellar.operators import dimensions
from starcellar.plans.warehouse import Day, Derived, Warehouse, unique

# Columns of an order head; all other fact columns belong to its lines.
HEAD_COLUMNS = {
    "sales": {"InvoiceDate": "OrderDate", "CustomerKey": "CustomerKey", "EmployeeKey": "EmployeeKey"},
    "purchases": {"PurchaseDate": "OrderDate"},
    "movements": {"MovementDate": "OrderDate"},
}
# What the lines call the fact's remaining columns, where the names differ.
LINE_COLUMNS = {
    "sales": {"InvoiceID": "OrderKey"},
    "purchases": {
        "PurchaseOrderID": "OrderKey", "QuantityOrdered": "Quantity", "UnitCostPrice": "UnitPrice",
        "LineCost": "ListAmount",
    },
    "movements": {"InvoiceID": "OrderKey"},
}


def _listed(rows: DataFrame, natural: str, key: str) -> DataFrame:
    return dimensions.with_natural_key(rows, natural, key)


class LayoutWarehouse(Warehouse):
    """The star over the given tables, joined when a query asks for it.

    Orders, lines and products are joined only where a query uses columns of both sides: every line has
    its order, product, customer and supplier, because the operational database enforces those references
    (``constraint_report`` checks them).  Tables whose references do not hold are resolved once before
    (``operators.resolve``), so that all queries see the same rows.
    """

    def __init__(self, tables: Tables):
        super().__init__(tables.spark)
        self.tables = tables

    def dimension(self, name: str) -> DataFrame:
        source = Operational(self.tables)
        return {
            "product": self.tables.products,
            "customer": self.tables.customers,
            "supplier": self.tables.suppliers,
            "location": self.tables.locations,
            "employee": lambda: _listed(dimensions.dim_employee(source.salespeople()), "EmployeeID", "EmployeeKey"),
            "delivery": lambda: _listed(
                dimensions.dim_delivery_method(source.delivery_methods()), "DeliveryMethodID", "DeliveryMethodKey"),
            "type": lambda: _listed(
                dimensions.dim_transaction_type(source.transaction_types()), "TransactionTypeID", "TransactionTypeKey"),
            "payment": lambda: _listed(
                dimensions.dim_payment_method(source.payment_methods()), "PaymentMethodID", "PaymentMethodKey"),
            "customer_place": lambda: self.place("customer", "Customer"),
            "supplier_place": lambda: self.place("supplier", "Supplier"),
        }[name]()

    def stock(self) -> DataFrame:
        return self.tables.stock()

    def calendar_bounds(self) -> DataFrame:
        return self.tables.calendar_bounds()

    def _lines(self, name: str) -> DataFrame:
        lines = self.tables.order_lines()
        if name == "purchases":
            bounds = self.calendar_bounds()
            first = bounds.select(F.col("first_day").cast("timestamp_ntz")).scalar()
            last = bounds.select(F.date_add("last_day", 1).cast("timestamp_ntz")).scalar()
            # A load looks up the expected date in the calendar and drops lines outside it.
            lines = lines.filter((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < last))
        return lines

    def _line_column(self, name: str, column: str) -> Column:
        if column == "ExpectedDate":
            return F.col("l_shipdate").cast("date").alias(column)
        if name == "movements" and column == "Quantity":
            signed = F.when(F.col("TransactionTypeKey") == "R", F.col("Quantity")).otherwise(-F.col("Quantity"))
            return signed.alias(column)
        if name == "movements" and column == "PurchaseOrderID":
            return F.when(F.col("TransactionTypeKey") == "R", F.col("OrderKey")).alias(column)
        return F.col(LINE_COLUMNS[name].get(column, column)).alias(column)

    def fact(
        self, name: str, columns: list[str], since: Day = None, until: Day = None, only: DataFrame | None = None
    ) -> DataFrame:
        if name == "payments":
            return self._payments(since, until).select(*columns)
        heads = HEAD_COLUMNS[name]
        from_head = [c for c in columns if c in heads]
        from_line = [c for c in columns if c not in heads]
        lines = self._lines(name).select("OrderKey", *(self._line_column(name, c) for c in from_line))
        restricted = since is not None or until is not None or only is not None
        if from_head or restricted:
            head = self.tables.order_heads(since, until)
            if only is not None:
                # Before the join, so that the lines meet the chosen orders only.
                head = head.join(F.broadcast(only), only.columns, "left_semi")
            lines = lines.join(head.select("OrderKey", *(F.col(heads[c]).alias(c) for c in from_head)), "OrderKey")
        return lines.select(*columns)

    def _payments(self, since: Day, until: Day) -> DataFrame:
        paid_in = self.tables.customer_payments(since, until).withColumnsRenamed(
            {"CustomerID": "CustomerKey", "PaymentMethodID": "PaymentMethodKey",
             "TransactionTypeID": "TransactionTypeKey"}
        )
        paid_out = self.tables.supplier_payments(since, until).withColumnsRenamed(
            {"SupplierID": "SupplierKey", "PaymentMethodID": "PaymentMethodKey",
             "TransactionTypeID": "TransactionTypeKey"}
        )
        return paid_in.withColumn("TransactionSource", F.lit("Customer")).unionByName(
            paid_out.withColumn("TransactionSource", F.lit("Supplier")), allowMissingColumns=True
        )

    def _only_heads(self, name: str, keys: list[str], inputs: list[str]) -> bool:
        """Whether rows are grouped by columns of their order alone and summed over columns of lines alone."""
        fact, heads = self.facts[name], HEAD_COLUMNS.get(name, {})
        if not keys or not all(self._own(fact, k) for k in keys):
            return False
        columns, _ = self._reach(fact, keys)
        return all(c in heads for c in columns) and not any(c in heads or c not in fact.columns for c in inputs)

    def _by_order(
        self, name: str, keys: list[str], sums: dict[str, Derived], since: Day, until: Day,
        order_counts: tuple[str, ...] = (),
    ) -> DataFrame:
        """Lines summed per order, joined with the orders, summed by columns of the order.

        The shuffle that sums lines per order is the one the join with the orders needs anyway, and an
        order with very many lines reaches that join as one row.  It also counts orders without a
        distinct count: each is one row of one group.
        """
        fact, heads = self.facts[name], HEAD_COLUMNS[name]
        inputs = unique(need for d in sums.values() for need in d.needs)
        lines = self._lines(name).select("OrderKey", *(self._line_column(name, c) for c in inputs))
        per_order = lines.groupBy("OrderKey").agg(
            *(F.sum(d.build()).alias(alias) for alias, d in sums.items()), *(F.lit(1).alias(c) for c in order_counts)
        )
        columns, _ = self._reach(fact, keys)
        head = self.tables.order_heads(since, until)
        head = head.select("OrderKey", *(F.col(heads[c]).alias(c) for c in columns))
        df = self._derive(per_order.join(head, "OrderKey"), fact, keys)
        return df.groupBy(*keys).agg(*(F.sum(alias).alias(alias) for alias in (*sums, *order_counts)))

    def _sums(self, name: str, keys: list[str], sums: dict[str, Derived], since: Day, until: Day) -> DataFrame:
        inputs = unique(need for d in sums.values() for need in d.needs)
        if self._only_heads(name, keys, inputs):
            return self._by_order(name, keys, sums, since, until)
        return super()._sums(name, keys, sums, since, until)

    def slice(
        self, name: str, by: list[str], measures: dict[str, str], counts: dict[str, str] | None = None,
        filters: dict[str, list] | None = None, since: Day = None, until: Day = None, unknown: bool = False,
    ) -> DataFrame:
        """As in the base class, but orders grouped by their own columns are counted as rows."""
        fact = self.facts[name]
        specs = {alias: fact.measures[measure] for alias, measure in measures.items()}
        sums = {alias: d for spec in specs.values() for alias, d in spec.sums.items()}
        inputs = unique(need for d in sums.values() for need in d.needs)
        orders = all(LINE_COLUMNS.get(name, {}).get(fact.counted[m]) == "OrderKey" for m in (counts or {}).values())
        simple = not filters and not any(spec.needs for spec in specs.values())
        if not (counts and orders and simple and self._only_heads(name, by, inputs)):
            return super().slice(name, by, measures, counts, filters, since, until, unknown)
        cells = self._by_order(name, by, sums, since, until, tuple(counts))
        return cells.select(*by, *(spec.total().alias(alias) for alias, spec in specs.items()), *counts)
