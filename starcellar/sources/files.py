"""Readers: delimited extracts, stored tables, database tables, and bounded fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_source(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read the named columns of ``;``-separated files with a header line, whatever else the files hold.

    Types are given, never inferred.  The header is read to find the columns by name; a column that is missing fails.
    A value that does not parse becomes NULL; ``unreadable`` counts those.
    """
    return _extract(spark, path, schema).select(*(F.col(f"typed.{name}") for name in _fields(schema)))


def unreadable(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row (column_name, values) for each column: how many given values do not parse as its type."""
    rows, names = _extract(spark, path, schema), _fields(schema)
    counts = rows.agg(*(
        F.count_if(F.col(f"given.{n}").isNotNull() & F.col(f"typed.{n}").isNull()).alias(f"c{i}") for i, n in enumerate(names)))
    return counts.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("values")) for i, n in enumerate(names)))).alias("x")).select("x.*")


def _fields(schema: T.StructType | str) -> list[str]:
    return (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names


def _extract(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Each line as the texts ``given`` and the values ``typed`` of the wanted columns."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.option("sep", ";").option("header", True).option("enforceSchema", False).csv(path)  # without a schema only the header is read
    missing = [f.name for f in wanted if f.name not in lines.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    given = [F.col(f"`{f.name}`").alias(f.name) for f in wanted]
    typed = [F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if f.dataType != T.StringType()
             else F.col(f"`{f.name}`").alias(f.name) for f in wanted]
    return lines.select(F.struct(*given).alias("given"), F.struct(*typed).alias("typed"))


def table_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one stored table.  Column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def database_source(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Read a database table in ``partitions`` parallel ranges of a numeric key instead of one connection."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
                 numPartitions=str(partitions), fetchsize="10000", **options)
        .load()
    )


# Fixed value: rows that the answer to a question has at most.
QUESTION_ROWS = 50


def limited_fetch(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows.  After an ``orderBy`` Spark plans this as a distributed top-k."""
    return df.limit(rows)
