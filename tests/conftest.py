import os
import sys
import datetime as dt

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import TABLES  # noqa: E402
from starcellar.layout import Tables  # noqa: E402
from starcellar.plans.layout_warehouse import LayoutWarehouse  # noqa: E402
from starcellar.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables on this machine")
    return SMALL


@pytest.fixture(scope="session")
def tables(spark, folder):
    return Tables(spark, folder)


@pytest.fixture(scope="session")
def warehouse(tables):
    return LayoutWarehouse(tables)


@pytest.fixture(scope="session")
def database(folder):
    return views_over(folder)


def views_over(folder):
    connection = duckdb.connect()
    for table in (t for t in TABLES if os.path.exists(f"{folder}/{t}.parquet")):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'"
                           if os.path.isdir(f"{folder}/{table}.parquet")
                           else f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def day(text):
    return dt.date.fromisoformat(text)


def as_sets(df):
    return sorted(map(tuple, df.collect()), key=repr)
