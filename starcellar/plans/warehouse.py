"""The star schema as a catalogue of facts, dimensions and additive measures.

A query names attributes and measures.  The catalogue works out which joins that takes and leaves the
others out, and sums each fact by its keys *before* it meets a dimension:

* the join moves one row per key instead of one per line, so a key that holds a third of all lines
  arrives as a handful of partial sums;
* no dimension is forced into a broadcast.  Customers and products grow with the data, so Spark decides
  from their size, and AQE from the measured size;
* calendar attributes are computed from the date of the row, so there is no calendar join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.functions.calendar import ATTRIBUTES, calendar_columns, date_key
from starcellar.operators.lookup import short_list

Day = dt.date | Column | None


@dataclass(frozen=True)
class Derived:
    """A column computed from other columns of the same fact or its dimensions."""

    needs: tuple[str, ...]
    build: Callable[[], Column]


@dataclass(frozen=True)
class Measure:
    """An additive measure: sums over the fact, combined after dimensions are joined.

    ``sums`` names partial sums over fact columns; ``total`` combines them per group, possibly with
    columns of a dimension (``needs``) that are constant within the group.
    """

    sums: dict[str, Derived]
    total: Callable[[], Column]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    """``listed``: a short list, which is sent to every task; ``table``: its name in questions, if it has one."""

    key: str
    attributes: tuple[str, ...]
    table: str | None = None
    listed: bool = False


@dataclass(frozen=True)
class Fact:
    """Columns a fact has itself, columns derived from them, the dimensions it reaches, its measures."""

    columns: tuple[str, ...]
    dimensions: tuple[str, ...]
    derived: dict[str, Derived] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    counted: dict[str, str] = field(default_factory=dict)
    """Distinct counts: measure name to the column whose values are counted."""


PLACE = ("City", "State", "Country", "Continent")
DIMENSIONS = {
    "product": Dimension(
        "ProductKey", ("ProductID", "Product", "Category", "Color", "Brand", "LastCostPrice"), "DimProduct"
    ),
    "customer": Dimension(
        "CustomerKey", ("CustomerID", "CustomerName", "CustomerCategory", "BuyingGroup", "LocationKey"), "DimCustomer"
    ),
    "supplier": Dimension(
        "SupplierKey", ("SupplierID", "SupplierName", "SupplierCategory", "LocationKey"), "DimSupplier"
    ),
    "location": Dimension("LocationKey", ("CityID", "City", "State", "Country", "Continent"), "DimLocation"),
    "employee": Dimension("EmployeeKey", ("EmployeeID", "FullName", "IsSalesperson"), "DimEmployee", True),
    "delivery": Dimension("DeliveryMethodKey", ("DeliveryMethodID", "DeliveryMethod"), "DimDeliveryMethod", True),
    "type": Dimension(
        "TransactionTypeKey", ("TransactionTypeID", "TransactionType"), "DimInventoryTransactionType", True
    ),
    "payment": Dimension("PaymentMethodKey", ("PaymentMethodID", "PaymentMethod"), "DimPaymentMethod", True),
    # One location in two roles, for facts that name both a customer and a supplier.
    "customer_place": Dimension("CustomerKey", tuple(f"Customer{a}" for a in PLACE)),
    "supplier_place": Dimension("SupplierKey", tuple(f"Supplier{a}" for a in PLACE)),
}


def copied(column: str) -> Derived:
    return Derived((column,), lambda: F.col(column))


def calendar_of(date: str, prefix: str = "") -> dict[str, Derived]:
    """All calendar attributes of a date column, for role-playing dates under a prefix."""
    return {
        prefix + name: Derived((date,), lambda build=build: build(F.col(date))) for name, build in ATTRIBUTES.items()
    }


def summed(column: str, kind: str | None = None) -> Measure:
    """Plain sum of one fact column, optionally widened first so that the sum cannot overflow."""
    value = Derived((column,), lambda: F.col(column).cast(kind) if kind else F.col(column))
    return Measure({f"sum_{column}": value}, lambda: F.col(f"sum_{column}"))


def counted_rows() -> Measure:
    return Measure({"row_total": Derived((), lambda: F.lit(1))}, lambda: F.col("row_total"))


ID = "decimal(20,0)"

PROFIT = Derived(("LineTotal", "Quantity", "LastCostPrice"), lambda: F.expr("LineTotal - Quantity * LastCostPrice"))
# Profit is linear in the cost of the product, so summing lines per product first is exact.
PROFIT_TOTAL = Measure(
    {"sum_LineTotal": copied("LineTotal"), "sum_Quantity": copied("Quantity")},
    lambda: F.expr("sum_LineTotal - sum_Quantity * LastCostPrice"),
    ("LastCostPrice",),
)


def _taxed_quantity() -> Column:
    """Quantity times the price with tax in percent."""
    return F.expr("QuantityOrdered * (100 + TaxRate)")


COST_AT_LAST = Measure(
    {"sum_taxed": Derived(("QuantityOrdered", "TaxRate"), _taxed_quantity)},
    lambda: F.expr("sum_taxed * LastCostPrice * 0.01BD"),
    ("LastCostPrice",),
)


def _when_source(source: str) -> Measure:
    name = f"sum_{source}"
    amount = Derived(
        ("TransactionSource", "TransactionAmount"),
        lambda: F.when(F.col("TransactionSource") == source, F.col("TransactionAmount")),
    )
    return Measure({name: amount}, lambda: F.col(name))


FACTS: dict[str, Fact] = {
    "sales": Fact(
        ("InvoiceID", "InvoiceDate", "ProductKey", "CustomerKey", "EmployeeKey", "DeliveryMethodKey", "Quantity",
         "UnitPrice", "TaxRate", "LineTotal"),
        ("product", "customer", "location", "employee", "delivery"),
        {
            **calendar_of("InvoiceDate"),
            "FullName": copied("EmployeeKey"),
            "DeliveryMethod": copied("DeliveryMethodKey"),
            "ProfitAmount": PROFIT,
        },
        {
            "revenue": summed("LineTotal"),
            "profit": PROFIT_TOTAL,
            "quantity": summed("Quantity"),
            "unit_price": summed("UnitPrice"),
            "tax_rate": summed("TaxRate"),
            "invoice_ids": summed("InvoiceID", ID),
            "lines": counted_rows(),
        },
        {"orders": "InvoiceID", "products": "ProductKey"},
    ),
    "purchases": Fact(
        ("PurchaseOrderID", "PurchaseDate", "ExpectedDate", "ProductKey", "SupplierKey", "DeliveryMethodKey",
         "QuantityOrdered", "UnitCostPrice", "TaxRate", "LineCost"),
        ("product", "supplier", "location", "delivery"),
        {
            **calendar_of("PurchaseDate"),
            **calendar_of("ExpectedDate", "Expected"),
            "DeliveryMethod": copied("DeliveryMethodKey"),
        },
        {
            "cost_at_order": summed("LineCost"),
            "cost_at_last": COST_AT_LAST,
            "quantity_ordered": summed("QuantityOrdered"),
            "unit_cost": summed("UnitCostPrice"),
            "purchase_order_ids": summed("PurchaseOrderID", ID),
            "lines": counted_rows(),
        },
        {"orders": "PurchaseOrderID"},
    ),
    "movements": Fact(
        ("MovementDate", "ProductKey", "InvoiceID", "PurchaseOrderID", "TransactionTypeKey", "Quantity"),
        ("product", "type"),
        {**calendar_of("MovementDate"), "TransactionType": copied("TransactionTypeKey")},
        {
            "quantity": summed("Quantity"),
            "invoice_ids": summed("InvoiceID", ID),
            "purchase_order_ids": summed("PurchaseOrderID", ID),
            "lines": counted_rows(),
        },
        {"orders": "PurchaseOrderID", "invoices": "InvoiceID"},
    ),
    "payments": Fact(
        ("TransactionDate", "CustomerKey", "SupplierKey", "InvoiceID", "PurchaseOrderID", "PaymentMethodKey",
         "TransactionTypeKey", "TransactionSource", "NetAmount", "TaxAmount", "TransactionAmount",
         "RemainingBalance"),
        ("customer", "supplier", "customer_place", "supplier_place", "payment", "type"),
        {**calendar_of("TransactionDate"), "TransactionType": copied("TransactionTypeKey")},
        {
            "net": summed("NetAmount"),
            "tax": summed("TaxAmount"),
            "amount": summed("TransactionAmount"),
            "balance": summed("RemainingBalance"),
            "invoice_ids": summed("InvoiceID", ID),
            "purchase_order_ids": summed("PurchaseOrderID", ID),
            "lines": counted_rows(),
            "receivables": _when_source("Customer"),
            "payables": _when_source("Supplier"),
        },
        {},
    ),
}


def unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


class Warehouse:
    """Facts and dimensions by name.  Subclasses say where a fact and a dimension come from."""

    facts = FACTS

    def __init__(self, spark: SparkSession):
        self.spark = spark

    # To be provided ------------------------------------------------------------------------------

    def fact(
        self, name: str, columns: list[str], since: Day = None, until: Day = None, only: DataFrame | None = None
    ) -> DataFrame:
        """The named columns of a fact, of rows dated ``since <= date < until``.

        ``only`` restricts the rows to the keys in its one column; callers cut it to a few rows before.
        """
        raise NotImplementedError

    def dimension(self, name: str) -> DataFrame:
        raise NotImplementedError

    def place(self, dim: str, prefix: str) -> DataFrame:
        """The members of a dimension with their location's columns under a prefix."""
        places = self.dimension("location").select("LocationKey", *(F.col(a).alias(f"{prefix}{a}") for a in PLACE))
        return self.dimension(dim).select(DIMENSIONS[dim].key, "LocationKey").join(places, "LocationKey").drop("LocationKey")

    def stock(self) -> DataFrame:
        raise NotImplementedError

    def calendar_bounds(self) -> DataFrame:
        raise NotImplementedError

    # Star ----------------------------------------------------------------------------------------

    def _own(self, fact: Fact, name: str) -> bool:
        """Whether a column can be had from the fact alone."""
        if name in fact.columns:
            return True
        derived = fact.derived.get(name)
        return derived is not None and all(self._own(fact, need) for need in derived.needs)

    def _reach(self, fact: Fact, names: Iterable[str]) -> tuple[list[str], list[str]]:
        """Fact columns and dimensions needed for the named columns."""
        columns, dims = [], []
        for name in names:
            if name in fact.columns:
                columns.append(name)
            elif name in fact.derived:
                more, further = self._reach(fact, fact.derived[name].needs)
                columns += more
                dims += further
            else:
                dim = self._dimension_of(fact, name)
                dims.append(dim)
                columns += self._path(fact, dim, dims)
        return unique(columns), unique(dims)

    def _dimension_of(self, fact: Fact, attribute: str) -> str:
        for dim in fact.dimensions:
            if attribute in DIMENSIONS[dim].attributes:
                return dim
        raise KeyError(f"no attribute {attribute}")

    def _path(self, fact: Fact, dim: str, dims: list[str]) -> list[str]:
        """The fact column leading to a dimension; a location is reached through its customer or supplier."""
        key = DIMENSIONS[dim].key
        if key in fact.columns:
            return [key]
        via = self._dimension_of(fact, key)
        dims.append(via)
        return [DIMENSIONS[via].key]

    def _attach(self, df: DataFrame, fact: Fact, dims: list[str], names: list[str], unknown: bool) -> DataFrame:
        """Join the dimensions, nearest first; with ``unknown`` rows without a member keep a visible one."""
        ordered = sorted(dims, key=lambda dim: DIMENSIONS[dim].key not in fact.columns)
        wanted = set(names)
        if "location" in dims:
            wanted.add("LocationKey")
        for dim in ordered:
            spec = DIMENSIONS[dim]
            attributes = [a for a in spec.attributes if a in wanted and a not in df.columns]
            members = self.dimension(dim).select(spec.key, *attributes)
            members = short_list(members) if spec.listed else members
            df = df.join(members, spec.key, "left" if unknown else "inner")
            if unknown:
                texts = {f.name for f in members.schema.fields if f.dataType.simpleString() == "string"}
                df = df.withColumns(
                    {a: F.coalesce(F.col(a), F.lit("Unknown")) for a in attributes if a in texts}
                )
        return df

    def _derive(self, df: DataFrame, fact: Fact, names: Iterable[str]) -> DataFrame:
        missing = [n for n in unique(names) if n not in df.columns and n in fact.derived]
        return df.withColumns({n: fact.derived[n].build() for n in missing}) if missing else df

    def star(
        self, name: str, columns: list[str], since: Day = None, until: Day = None, where: Column | None = None,
        where_needs: tuple[str, ...] = (), unknown: bool = False, only: DataFrame | None = None,
    ) -> DataFrame:
        """One row per fact row with any columns of the fact, its calendar and its dimensions."""
        fact = self.facts[name]
        wanted = unique([*columns, *where_needs])
        own, dims = self._reach(fact, wanted)
        attributes = unique([*wanted, *(n for w in wanted if w in fact.derived for n in fact.derived[w].needs)])
        df = self.fact(name, own, since, until, only)
        df = self._derive(self._attach(df, fact, dims, attributes, unknown), fact, wanted)
        return (df.filter(where) if where is not None else df).select(*columns)

    def totals(
        self, name: str, by: list[str], measures: dict[str, str], since: Day = None, until: Day = None,
        where: Column | None = None, where_needs: tuple[str, ...] = (), unknown: bool = False,
    ) -> DataFrame:
        """Additive measures by attributes; ``measures`` maps the output name to the measure.

        Sums by key first, then joins the dimensions, then sums by attribute.  Two large dimensions at once
        have about as many pairs of keys as there are rows, so then products are joined to the rows and the
        sums are made by the other key.
        """
        fact = self.facts[name]
        specs = {alias: fact.measures[measure] for alias, measure in measures.items()}
        attributes = unique([*by, *where_needs])
        own = [a for a in attributes if self._own(fact, a)]
        other = unique([a for a in attributes if a not in own] + [n for s in specs.values() for n in s.needs])
        path, dims = self._reach(fact, other)
        keys = unique([*own, *path])
        sums: dict[str, Derived] = {}
        for spec in specs.values():
            sums.update(spec.sums)
        if "product" in dims and len(dims) > 1:
            shown = [a for a in attributes if a in DIMENSIONS["product"].attributes]
            df, specs = self._sums_with_products(name, own, other, shown, specs, sums, since, until, unknown)
            dims = [d for d in dims if d != "product"]
        else:
            df = self._sums(name, keys, sums, since, until)
        df = self._attach(df, fact, dims, other, unknown)
        if where is not None:
            df = df.filter(where)
        if not dims and where is None:
            return df.select(*by, *(spec.total().alias(alias) for alias, spec in specs.items()))
        return df.groupBy(*by).agg(*(F.sum(spec.total()).alias(alias) for alias, spec in specs.items()))

    def _sums_with_products(
        self, name: str, own: list[str], other: list[str], shown: list[str], specs: dict[str, Measure],
        sums: dict[str, Derived], since: Day, until: Day, unknown: bool,
    ) -> tuple[DataFrame, dict[str, Measure]]:
        """Measures by the keys of all dimensions but products, which are joined to the rows."""
        fact = self.facts[name]
        product = [a for a in DIMENSIONS["product"].attributes if a in other]
        keys = unique([*own, *self._reach(fact, [a for a in other if a not in product])[0]])
        inputs = unique([*keys, "ProductKey", *(need for d in sums.values() for need in d.needs)])
        columns, _ = self._reach(fact, inputs)
        rows = self._attach(self.fact(name, columns, since, until), fact, ["product"], product, unknown)
        rows = self._derive(rows, fact, keys).withColumns({alias: d.build() for alias, d in sums.items()})
        df = rows.groupBy(*keys, *shown).agg(*(F.sum(spec.total()).alias(alias) for alias, spec in specs.items()))
        totals = {alias: Measure({}, lambda alias=alias: F.col(alias)) for alias in specs}
        return df, totals

    def _sums(self, name: str, keys: list[str], sums: dict[str, Derived], since: Day, until: Day) -> DataFrame:
        """Partial sums by columns the fact has itself."""
        fact = self.facts[name]
        inputs = unique([*keys, *(need for d in sums.values() for need in d.needs)])
        columns, _ = self._reach(fact, inputs)
        df = self._derive(self.fact(name, columns, since, until), fact, keys)
        return df.groupBy(*keys).agg(*(F.sum(d.build()).alias(alias) for alias, d in sums.items()))

    def distinct_counts(
        self, name: str, by: list[str], counts: dict[str, str], since: Day = None, until: Day = None
    ) -> DataFrame:
        """Distinct counts by attributes; not additive, so always made at the wanted grain."""
        counted = self.facts[name].counted
        columns = {alias: counted[measure] for alias, measure in counts.items()}
        df = self.star(name, unique([*by, *columns.values()]), since, until)
        return df.groupBy(*by).agg(*(F.count_distinct(F.col(c)).alias(alias) for alias, c in columns.items()))

    def slice(
        self, name: str, by: list[str], measures: dict[str, str], counts: dict[str, str] | None = None,
        filters: dict[str, list] | None = None, since: Day = None, until: Day = None, unknown: bool = False,
    ) -> DataFrame:
        """Any measures by any attributes, empty cells left out, attributes filtered to lists of values.

        Distinct counts do not survive summing by key first; with them the rows are grouped once, where
        Spark's two-step distinct aggregation spreads a large group over the counted column.
        """
        filters = filters or {}
        where = None
        for attribute, values in filters.items():
            condition = F.col(attribute).isin(values)
            where = condition if where is None else where & condition
        since, until = self._covering(filters, since, until)
        needs = tuple(filters)
        if not counts:
            return self.totals(name, by, measures, since, until, where, needs, unknown)
        fact = self.facts[name]
        specs = {alias: fact.measures[measure] for alias, measure in measures.items()}
        columns = {alias: fact.counted[measure] for alias, measure in counts.items()}
        inputs = [n for s in specs.values() for d in s.sums.values() for n in d.needs]
        inputs += [n for s in specs.values() for n in s.needs]
        rows = self.star(name, unique([*by, *inputs, *columns.values()]), since, until, where, needs, unknown)
        sums = {alias: d for spec in specs.values() for alias, d in spec.sums.items()}
        rows = rows.withColumns({alias: d.build() for alias, d in sums.items()}) if sums else rows
        return rows.groupBy(*by).agg(
            *(F.sum(spec.total()).alias(alias) for alias, spec in specs.items()),
            *(F.count_distinct(F.col(c)).alias(alias) for alias, c in columns.items()),
        )

    @staticmethod
    def _covering(filters: dict[str, list], since: Day, until: Day) -> tuple[Day, Day]:
        """A date range that covers the filtered years, so that the scan can skip the rest."""
        years = filters.get("YearNumber")
        if not years or since is not None or until is not None:
            return since, until
        return dt.date(min(years), 1, 1), dt.date(max(years) + 1, 1, 1)

    def latest_year_start(self) -> Column:
        """First day of the calendar's last year, as a scalar subquery."""
        return self.calendar_bounds().select(F.trunc("last_day", "YEAR")).scalar()

    def tables_for_sql(self) -> dict[str, DataFrame]:
        """The warehouse tables by name.  Building them is lazy: only what a query reads is computed."""
        bounds = self.calendar_bounds()
        days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
        tables = {"DimDate": days.select(*calendar_columns(F.col("day"))), "FactInventory": self.stock()}
        tables |= {spec.table: self.dimension(dim) for dim, spec in DIMENSIONS.items() if spec.table}
        for name, (table, keys, extra) in SQL_TABLES.items():
            fact = self.facts[name]
            own = [c for c in fact.columns if c not in keys.values()]
            rows = self.star(name, [*own, *extra, *keys.values()])
            dates = {key: date_key(F.col(date)) for key, date in keys.items()}
            tables[table] = rows.withColumns(dates).drop(*keys.values())
        return tables


# Table names of the facts, their date keys, and derived columns that belong to the table.
SQL_TABLES: dict[str, tuple[str, dict[str, str], list[str]]] = {
    "sales": ("FactSales", {"InvoiceDateKey": "InvoiceDate"}, ["ProfitAmount"]),
    "purchases": (
        "FactPurchases", {"PurchaseDateKey": "PurchaseDate", "ExpectedDeliveryDateKey": "ExpectedDate"}, [],
    ),
    "movements": ("FactInventoryTransactions", {"DateKey": "MovementDate"}, []),
    "payments": ("FactFinancialTransactions", {"DateKey": "TransactionDate"}, []),
}
