"""Monthly cells and distinct parts kept beside the facts of a loaded star, and a warehouse that answers from them.

Cells are sums by month and some keys of a fact, so they hold for whatever attributes the members have at present, and
sums of cells are the sums of the lines.  Distinct counts do not add up, so for them the counted ids are kept as bits:
one bitmap for each 32,768 ids by month and attribute, which coarser cells combine with OR and count.

Both are kept by what a load adds.  The snapshot records which parts of the fact they cover, so a run that did not keep
them is caught up with by the next one, and a reader only uses what covers its whole snapshot.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.plans.loaded_warehouse import DATE_KEYS, TABLES, LoadedWarehouse
from starcellar.plans.star_load import DIMENSIONS as MEMBERS
from starcellar.plans.star_load import Draft, in_turn, together
from starcellar.plans.warehouse import DIMENSIONS, Day, Derived, Fact, unique
from starcellar.session import CODEC
from starcellar.sources.snapshots import Snapshot, Snapshots

# Calendar attributes that all days of a month share.
OF_MONTH = ("YearNumber", "QuarterNumber", "QuarterName", "MonthNumber", "MonthName", "MonthYear")
MERGE_AT = 16  # so many parts of small loads are merged into one
BUCKET, BITS = "bucket", "bits"


@dataclass(frozen=True)
class Cells:
    """All additive measures of a fact by month and some of its own columns."""

    table: str
    fact: str
    by: tuple[str, ...]

    def sums(self, fact: Fact) -> dict[str, Derived]:
        return {alias: d for m in fact.measures.values() for alias, d in m.sums.items()}

    def build(self, w: LoadedWarehouse) -> DataFrame:
        fact, date = w.facts[self.fact], month_of(self.fact)
        sums = self.sums(fact)
        inputs = unique([date, *self.by, *(n for d in sums.values() for n in d.needs)])
        rows = w.star(self.fact, inputs).withColumns({alias: d.build() for alias, d in sums.items()})
        return self.merge(rows.withColumn(date, F.trunc(date, "MM")), [date, *self.by], sums)

    def merge(self, rows: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*(F.sum(s).alias(s) for s in sums))

    def merged(self, rows: DataFrame) -> DataFrame:
        key = [month_of(self.fact), *self.by]
        return self.merge(rows, key, [c for c in rows.columns if c not in key])


@dataclass(frozen=True)
class Distinct:
    """The ids that a distinct count counts, as bits, by month and attributes of the fact or its dimensions."""

    table: str
    fact: str
    count: str
    by: tuple[str, ...]

    def build(self, w: LoadedWarehouse) -> DataFrame:
        counted, date = w.facts[self.fact].counted[self.count], month_of(self.fact)
        # Bits are kept for whole numbers; an id of another kind would be a reason not to list it below.
        rows = w.star(self.fact, unique([date, *self.by, counted])).filter(F.col(counted).isNotNull())
        id_ = F.col(counted).cast("bigint")
        rows = rows.select(F.trunc(date, "MM").alias(date), *self.by, F.bitmap_bucket_number(id_).alias(BUCKET),
                           F.bitmap_bit_position(id_).alias("position"))
        # Ids are shuffled, not bitmaps: every task has ids of nearly every bucket, and a bitmap of few ids is still 4 KB.
        return rows.repartition(date, *self.by, BUCKET).groupBy(date, *self.by, BUCKET).agg(
            F.bitmap_construct_agg("position").alias(BITS))

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(month_of(self.fact), *self.by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


Kept = Cells | Distinct

# Coarser cells stand before finer ones, as the first that can answer is taken.
KEPT: tuple[Kept, ...] = (
    Cells("SalesBySeller", "sales", ("EmployeeKey", "DeliveryMethodKey")),
    Cells("SalesByProduct", "sales", ("ProductKey",)),
    Cells("SalesByCustomer", "sales", ("CustomerKey",)),
    Cells("PurchasesByDelivery", "purchases", ("DeliveryMethodKey",)),
    Cells("PurchasesBySupplier", "purchases", ("SupplierKey",)),
    Cells("PurchasesByProduct", "purchases", ("ProductKey",)),
    Cells("MovementsByType", "movements", ("TransactionTypeKey",)),
    Cells("MovementsByProduct", "movements", ("ProductKey", "TransactionTypeKey")),
    Cells("PaymentsByType", "payments", ("TransactionSource", "TransactionTypeKey", "PaymentMethodKey")),
    Distinct("Invoices", "sales", "orders", ()),
    Distinct("InvoicesByCategory", "sales", "orders", ("Category",)),
    Distinct("PurchaseOrders", "purchases", "orders", ()),
)


# Keys of dimensions that are no short lists: rows by month and one of them are many.
MEMBER_KEYS = {key for _, key, listed in MEMBERS.values() if not listed}


def is_long(kept: Kept) -> bool:
    """Whether there can be nearly as many rows as lines: distinct parts, and cells by product, customer or supplier."""
    return isinstance(kept, Distinct) or not MEMBER_KEYS.isdisjoint(kept.by)


def month_of(fact: str) -> str:
    """The date column of a fact that its months follow; cells keep the month's first day in it."""
    return next(iter(DATE_KEYS[fact]))


def coverage(kept: Kept) -> str:
    return f"{kept.table} covers"


def described(kept: Kept, facts: dict[str, Fact]) -> list[str]:
    """Dimensions whose attributes are written into the stored rows."""
    own = facts[kept.fact].columns
    return [d for d in facts[kept.fact].dimensions if any(a in DIMENSIONS[d].attributes for a in kept.by if a not in own)]


def wanted_coverage(kept: Kept, snapshot: Snapshot) -> tuple[str, ...]:
    """Parts of the fact, and of the dimensions whose attributes are stored."""
    tables = [TABLES[kept.fact], *(TABLES[d] for d in described(kept, LoadedWarehouse.facts))]
    return tuple(f"{t}/{part}" for t in tables for part in snapshot.parts.get(t, ()))


def _relabelled(draft: Draft, kept: Kept, covered: set[str]) -> bool:
    """Whether a member of a described dimension has other attributes than when the parts were written."""
    for dim in described(kept, LoadedWarehouse.facts):
        table, key = TABLES[dim], DIMENSIONS[dim].key
        before = tuple(c.removeprefix(f"{table}/") for c in covered if c.startswith(f"{table}/"))
        if before == draft.snapshot.parts[table]:
            continue
        stored = [a for a in kept.by if a in DIMENSIONS[dim].attributes]
        old = draft.store.read(table, replace(draft.snapshot, parts={table: before})).select(
            key, F.struct(*stored).alias("before"))
        now = draft.read(table).select(key, F.struct(*stored).alias("now"))
        if old.join(now, key).filter(~F.col("before").eqNullSafe(F.col("now"))).limit(1).count():
            return True
    return False


def keep_up(draft: Draft, kept: Sequence[Kept] = KEPT) -> None:
    """Bring cells and distinct parts to what the draft holds, by the parts of the fact they do not cover yet.

    They are built anew only where parts they cover are gone or a stored attribute of a member has changed.
    """
    def bring(one: Kept) -> None:
        table, want = TABLES[one.fact], wanted_coverage(one, draft.snapshot)
        covered = set(draft.base.parts.get(coverage(one), ()))
        if table not in draft.snapshot.parts or covered == set(want):
            return
        held = {c for c in covered if c.startswith(f"{table}/")}
        anew = not covered or not held <= set(want) or _relabelled(draft, one, covered)
        parts = tuple(p for p in draft.snapshot.parts[table] if anew or f"{table}/{p}" not in held)
        if parts or anew:
            view = replace(draft.snapshot, parts={**draft.snapshot.parts, table: parts})
            rows = one.build(LoadedWarehouse(draft.store, view))
            merging = not anew and len(draft.snapshot.parts[one.table]) >= MERGE_AT
            rows = one.merged(draft.read(one.table).unionByName(rows)) if merging else rows
            draft.put(one.table, rows.sortWithinPartitions(month_of(one.fact)), keep=not anew and not merging, codec=CODEC)
        draft.snapshot.parts[coverage(one)] = want

    jobs = {one: lambda one=one: bring(one) for one in kept}
    together([in_turn([job for one, job in jobs.items() if is_long(one)]), *(job for one, job in jobs.items() if not is_long(one))])


class RolledWarehouse(LoadedWarehouse):
    """Answers from the coarsest stored cells that can; others are read from the lines, or refused where ``strict``."""

    def __init__(self, store: Snapshots, strict: bool = False, kept: Sequence[Kept] = KEPT):
        super().__init__(store)
        self.strict = strict
        self.kept = [k for k in kept if set(self.snapshot.parts.get(coverage(k), ("none",)))
                     == set(wanted_coverage(k, self.snapshot))]

    def fact(self, name: str, columns: list[str], since: Day = None, until: Day = None, only: DataFrame | None = None) -> DataFrame:
        if self.strict:
            raise ValueError(f"no stored cells of {name} answer this")
        return super().fact(name, columns, since, until, only)

    def _fits(self, one: Kept, names: Sequence[str], since: Day, until: Day) -> bool:
        """Whether the stored rows have all names, and whole months lie in the time asked for."""
        derived, date = self.facts[one.fact].derived, month_of(one.fact)
        months = all(n in OF_MONTH and n in derived and derived[n].needs == (date,) for n in names if n not in one.by)
        return months and all(d is None or isinstance(d, dt.date) and d.day == 1 for d in (since, until))

    def _stored(self, one: Kept, names: Sequence[str], since: Day, until: Day) -> DataFrame:
        rows, date = self._read(one.table), F.col(month_of(one.fact))
        rows = rows if since is None else rows.filter(date >= F.lit(since))
        rows = rows if until is None else rows.filter(date < F.lit(until))
        return self._derive(rows, self.facts[one.fact], names)

    def cells_for(self, name: str, keys: Sequence[str], sums: dict[str, Derived], since: Day = None, until: Day = None) -> Cells | None:
        """The coarsest stored cells with these keys and sums."""
        for one in self.kept:
            if isinstance(one, Cells) and one.fact == name and self._fits(one, keys, since, until):
                have = one.sums(self.facts[name])
                if all(have.get(alias) is d for alias, d in sums.items()):
                    return one
        return None

    def _sums(self, name: str, keys: list[str], sums: dict[str, Derived], since: Day, until: Day) -> DataFrame:
        one = self.cells_for(name, keys, sums, since, until)
        if one is None:
            return super()._sums(name, keys, sums, since, until)
        return one.merge(self._stored(one, keys, since, until), keys, list(sums))

    def _counted(self, name: str, measure: str, by: Sequence[str], needs: Sequence[str], since: Day, until: Day) -> Distinct | None:
        names = unique([*by, *needs])
        return next((k for k in self.kept if isinstance(k, Distinct) and (k.fact, k.count) == (name, measure)
                     and self._fits(k, names, since, until)), None)

    def _count(self, one: Distinct, alias: str, by: Sequence[str], where: Column | None, needs: Sequence[str], since: Day,
               until: Day) -> DataFrame:
        rows = self._stored(one, unique([*by, *needs]), since, until)
        rows = rows if where is None else rows.filter(where)
        united = rows.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
        return united.groupBy(*by).agg(F.sum(F.bitmap_count(BITS)).alias(alias))

    def distinct_counts(self, name: str, by: list[str], counts: dict[str, str], since: Day = None, until: Day = None) -> DataFrame:
        found = {alias: self._counted(name, m, by, (), since, until) for alias, m in counts.items()}
        if not by or not all(found.values()):
            return super().distinct_counts(name, by, counts, since, until)
        tables = [self._count(one, alias, by, None, (), since, until) for alias, one in found.items()]
        return reduce(lambda left, right: beside(left, right, by), tables)

    def slice(
        self, name: str, by: list[str], measures: dict[str, str], counts: dict[str, str] | None = None,
        filters: dict[str, list] | None = None, since: Day = None, until: Day = None, unknown: bool = False,
    ) -> DataFrame:
        """Sums from cells beside counts from distinct parts; with a count that no parts hold, all from the lines."""
        filters, needs = filters or {}, tuple(filters or ())
        first, end = self._covering(filters, since, until)
        found = {alias: self._counted(name, m, by, needs, first, end) for alias, m in (counts or {}).items()}
        if not counts or not by or unknown or not measures or not all(found.values()):
            return super().slice(name, by, measures, counts, filters, since, until, unknown)
        conditions = [F.col(a).isin(values) for a, values in filters.items()]
        where = reduce(lambda a, b: a & b, conditions) if conditions else None
        cells = super().slice(name, by, measures, None, filters, since, until)
        for alias, one in found.items():
            cells = beside(cells, self._count(one, alias, by, where, needs, first, end), by)
            cells = cells.withColumn(alias, F.coalesce(alias, F.lit(0).cast("bigint")))
        return cells


def beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of two tables with one row by the same attributes, NULL being a value like others."""
    named = right.withColumnsRenamed({b: f"_{b}" for b in by})
    same: Callable[[str], Column] = lambda b: F.col(b).eqNullSafe(F.col(f"_{b}"))
    return left.join(named, [same(b) for b in by], "left").drop(*(f"_{b}" for b in by))
