"""Stored tables that are changed row by row: kept in hash buckets, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from starcellar.operators.upkeep import CHANGED, NEW, change_set, upsert
from starcellar.sources.snapshots import Snapshots

BUCKETS = 64
INSERT, UPDATE, DELETE = "insert", "update", "delete"
SEQUENCE, GONE = "_sequence", "_gone"


class BucketedTable:
    """A table with one row per key below the root of ``store``, in ``buckets`` by the hash of its key.

    The manifest names the part that holds each bucket.  A change writes a part with the buckets in which a row
    changes, and the manifest keeps the parts of the others, so a small change costs a few buckets and readers see it at
    once.  The number of buckets is part of the table; it is chosen so that one bucket fits a task.
    """

    def __init__(self, store: Snapshots, name: str, key: str, columns: Sequence[str], buckets: int = BUCKETS):
        self.store, self.name, self.key, self.columns, self.buckets = store, name, key, list(columns), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def parts(self) -> tuple[str, ...]:
        """Part and bucket of everything in use, ``<part>/bucket=<n>``."""
        return self.store.current().parts.get(self.name, ())

    def _read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        snapshot = self.store.current()
        if self.name not in snapshot.parts:
            return None
        wanted = None if only is None else {f"bucket={n}" for n in only}
        parts = [p for p in snapshot.parts[self.name] if wanted is None or p.split("/")[1] in wanted]
        return self.store.read(self.name, replace(snapshot, parts={self.name: parts})).drop("part")

    def read(self) -> DataFrame:
        """The rows of the present snapshot, without the marks of deleted ones."""
        rows = self._read()
        if rows is None:
            raise FileNotFoundError(f"no table {self.name} below {self.store.root}")
        return (rows.filter(~F.col(GONE)) if GONE in rows.columns else rows).select(self.key, *self.columns)

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew."""
        self._put(rows.withColumn("bucket", self._bucket()), None)

    def upsert(self, incoming: DataFrame) -> list[int]:
        """A type-1 upsert: new rows added, changed ones replaced, missing ones kept; returns the buckets written."""
        stored = self._read()
        if stored is None:
            self.replace(incoming.select(self.key, *self.columns))
            return sorted(int(p.split("=")[1]) for p in self.parts())
        change = change_set(stored, incoming, self.key, self.columns).filter(F.col("change").isin(NEW, CHANGED))
        touched = self._touched(change)
        if touched:
            mine = incoming.filter(self._bucket().isin(touched))
            rows = upsert(self._read(touched), mine, self.key, self.columns)
            self._put(rows.withColumn("bucket", self._bucket()), touched)
        return touched

    def apply(self, events: DataFrame, operation: str, sequence: str) -> list[int]:
        """Apply change events (key, ``operation``, ``sequence``, columns) and return the buckets written.

        The last event of a key by its sequence counts; of events with one sequence a deletion, else the greatest by
        columns.  A row keeps the sequence it came from, and a deleted one stays as a mark with its sequence, so an
        event older than what the table has changes nothing: any order and any cutting into runs ends in the same table.
        Events without key or sequence are left out.
        """
        shape = [self.key, *self.columns, SEQUENCE, GONE]
        fields = [F.col(sequence).cast("long").alias(SEQUENCE), (F.col(operation) == DELETE).alias(GONE), *self.columns]
        known = events.filter(F.col(self.key).isNotNull() & F.col(sequence).isNotNull())
        last = known.groupBy(self.key).agg(F.max(F.struct(*fields)).alias("event")).select(self.key, "event.*").select(shape)
        stored = self._read()
        if stored is None:
            self._put(last.withColumn("bucket", self._bucket()), None)
            return sorted(int(p.split("=")[1]) for p in self.parts())
        event = F.struct(SEQUENCE, GONE, *self.columns)
        held = stored.select(F.col(self.key).alias("_key"), event.alias("_held"))
        newer = last.join(held, F.col(self.key) == F.col("_key"), "left").filter(
            F.col("_held").isNull() | (event > F.col("_held"))).select(shape)
        touched = self._touched(newer)
        if touched:
            both = self._read(touched).select(shape).unionByName(last.filter(self._bucket().isin(touched)))
            rows = both.groupBy(self.key).agg(F.max(event).alias("row"))
            self._put(rows.select(self.key, "row.*").withColumn("bucket", self._bucket()), touched)
        return touched

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.bucket for r in rows.select(self._bucket().alias("bucket")).distinct().collect())

    def _put(self, rows: DataFrame, touched: Sequence[int] | None) -> None:
        """Write buckets as one part and publish them; ``touched``: those that the part replaces, else all."""
        snapshot = self.store.current()
        part = self.store.write(rows.repartition("bucket"), self.name, ("bucket",))
        schema = StructType([*(f for f in rows.schema.fields if f.name != "bucket"), StructField("bucket", IntegerType()),
                             StructField("part", StringType())])
        written = self.store.read_parts(self.name, (part,), schema).select("bucket").distinct().collect()
        replaced = None if touched is None else {f"bucket={n}" for n in touched}
        kept = [] if replaced is None else [p for p in snapshot.parts[self.name] if p.split("/")[1] not in replaced]
        parts = sorted([*kept, *(f"{part}/bucket={r.bucket}" for r in written)])
        self.store.publish(replace(
            snapshot, number=snapshot.number + 1, parts={**snapshot.parts, self.name: tuple(parts)},
            schemas={**snapshot.schemas, self.name: schema.json()}))
