"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from kgspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def text(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, database, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = sorted(tuple(map(text, row)) for row in frame.select(*columns).collect())
    cursor = database.execute(registry.SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    assert found == sorted(tuple(text(row[i]) for i in places) for row in cursor.fetchall())
    assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
