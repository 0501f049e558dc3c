"""The registered text queries against their SQL, and that every operator is registered."""

import duckdb
import pytest

import __spark_entry__ as entries
from checks.compare import compare
from tidewatch.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_every_operator_is_registered():
    names = entries.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(queries.SQL) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    same, note = compare(spark, connection, FOLDER, name, entries.queries()[name], entries.oracle_sql()[name])
    assert same, note
