"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

# Settings the jobs rely on.  All are Spark's own switches: run-time re-planning, splitting of skewed
# join partitions, coalescing of small shuffle partitions, and UTC so that dates equal on every host.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

CODEC = "zstd"  # of stored tables that grow with the lines
# While a run writes, the shuffle files of a table go as soon as it is written, not when the driver happens to collect its
# garbage, so they never lie beside those of all tables before it.  And a member takes several times more memory than its
# compressed columns take in files, by whose size Spark decides what the driver collects and sends to all tasks.
RUN_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": "8",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark.  A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("starcellar")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings for a while; those it had before come back, whatever happens."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a machine-local
    folder would lose the data together with the machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # a local cluster's executors are processes of their own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="starcellar-")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; never reused, so runs cannot see each other's files."""
    return f"{shared_dir(spark)}/starcellar/{purpose}-{uuid.uuid4().hex}"
