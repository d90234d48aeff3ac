"""Several tables that change together: parts written beside each other, and a manifest that names those in use."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

MANIFEST = "parts MAP<STRING, ARRAY<STRING>>, schemas MAP<STRING, STRING>, marks MAP<STRING, DATE>"


@dataclass(frozen=True)
class Snapshot:
    """Parts of each table in use, the tables' schemas, and the date up to which each was loaded."""

    number: int = 0
    parts: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    marks: Mapping[str, dt.date] = field(default_factory=dict)


class Snapshots:
    """Tables below ``root``, each a set of parts; what readers see is the manifest with the highest number.

    A part is a folder that is written once and never changed.  Nobody reads it until a manifest names it, and a
    manifest is one small file, so all tables and marks switch together, and a writer that dies leaves folders that
    nobody names.  One writer works at a time; readers need no lock, as the parts of their snapshot stay.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def current(self) -> Snapshot:
        try:
            files = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").inputFiles()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return Snapshot()
            raise
        numbered = sorted((int(m[1]), f) for f in files if (m := re.search(r"/number=(\d+)/", f)))
        if not numbered:
            return Snapshot()
        number, file = numbered[-1]
        row = self.spark.read.schema(MANIFEST).json(file).first()
        return Snapshot(number, {t: tuple(p) for t, p in row.parts.items()}, row.schemas, row.marks)

    def write(self, df: DataFrame, table: str, partition_by: Sequence[str] = (), codec: str | None = None) -> str:
        """Write a part that no manifest names yet, and return its name; ``codec``: other than the session's."""
        part = uuid.uuid4().hex
        path = f"{self.root}/{table}/part={part}"
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path, compression=codec)
        return part

    def read(self, table: str, snapshot: Snapshot) -> DataFrame:
        """All parts of a table, without rows if it has none yet."""
        schema = StructType.fromJson(json.loads(snapshot.schemas[table]))
        return self.read_parts(table, snapshot.parts[table], schema)

    def read_parts(self, table: str, parts: Sequence[str], schema: StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        reader = self.spark.read.schema(schema).option("basePath", base)
        return reader.parquet(*(f"{base}/part={part}" for part in parts))

    def publish(self, snapshot: Snapshot) -> Snapshot:
        """Make a snapshot the one readers see."""
        row = ({t: list(p) for t, p in snapshot.parts.items()}, dict(snapshot.schemas), dict(snapshot.marks))
        manifest = self.spark.createDataFrame([row], MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").json(f"{self.root}/manifest/number={snapshot.number:012d}")
        return snapshot
