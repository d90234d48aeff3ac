"""Appending to a checked table: rows that break a rule go to quarantine with their reasons, the others are accepted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.schemas import Rules

REASONS, ACCEPTED, LOAD = "reasons", "accepted", "load_id"


def with_reasons(rows: DataFrame, rules: Rules, parents: Mapping[str, DataFrame]) -> DataFrame:
    """The rows with ``reasons``: the names of the rules each breaks, in the order of the rules, none if it is fine.

    What a row shows by itself is one expression.  A reference is looked up in the distinct keys of its parent by a left
    join that marks what it finds, so rows are neither lost nor multiplied; a missing reference breaks no rule.  Rows
    that share their key with another row of the load are found by counting keys.
    """
    key = [rules.key] if isinstance(rules.key, str) else list(rules.key)
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = counted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.lit(True).alias("_shared"))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    marked = rows.join(shared, match, "left").drop(*(f"_k{i}" for i in range(len(key))))
    broken = [(f"primary_key {', '.join(key)}", F.col("_shared").isNotNull())]
    broken += [(f"not_null {c}", F.col(c).isNull()) for c in rules.required]
    broken += [(f"check {name}", ~F.expr(condition)) for name, condition in rules.checks.items()]
    broken += [(f"length {c}", F.length(c) > n) for c, n in rules.lengths.items()]
    for i, (column, (parent, parent_key)) in enumerate(rules.references.items()):
        known = parents[parent].select(F.col(parent_key).alias(f"_p{i}")).distinct()
        marked = marked.join(known, F.col(column) == F.col(f"_p{i}"), "left")
        broken.append((f"foreign_key {column}", F.col(column).isNotNull() & F.col(f"_p{i}").isNull()))
    reasons = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in broken)))
    return marked.select(*rows.columns, reasons.alias(REASONS))


class CheckedTable:
    """A stored table with its quarantine beside it, appended to load by load."""

    def __init__(self, spark: SparkSession, root: str, rules: Rules):
        self.spark, self.root, self.rules = spark, root, rules

    def append(self, rows: DataFrame, load_id: str, parents: Mapping[str, DataFrame]) -> None:
        """Check rows and write them as the load ``load_id``, accepted and rejected ones in one pass.

        A load that is repeated under its id takes the place of what it wrote before, of both kinds.
        """
        tagged = with_reasons(rows, self.rules, parents).withColumn(ACCEPTED, F.size(REASONS) == 0)
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(ACCEPTED).parquet(
            f"{self.root}/{LOAD}={load_id}")

    def _read(self, accepted: bool) -> DataFrame:
        return self.spark.read.parquet(self.root).filter(F.col(ACCEPTED) == F.lit(accepted)).drop(ACCEPTED)

    def accepted(self) -> DataFrame:
        return self._read(True).drop(REASONS)

    def rejected(self) -> DataFrame:
        """The quarantine: rows as they came, with the reasons and the load."""
        return self._read(False)
