"""Every query against its SQL counterpart, on the smallest tables."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as contract
from postbag.plans.oracle import SQL
from postbag.plans.queries import QUERIES
from tests.conftest import SMALL

TABLES = ("conversations", "documents", "pages")
KINDS = {
    T.StringType(): {"VARCHAR"},
    T.IntegerType(): {"INTEGER"},
    T.LongType(): {"BIGINT"},
    T.BooleanType(): {"BOOLEAN"},
    T.TimestampNTZType(): {"TIMESTAMP"},
}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def comparable(row):
    return tuple(
        (value is None, "" if value is None or (isinstance(value, float) and math.isnan(value)) else str(value))
        if not isinstance(value, datetime.datetime)
        else (False, value.isoformat())
        for value in row
    )


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    ours = QUERIES[name](spark, SMALL)
    theirs = sql.execute(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(c[0] for c in theirs.description)
    types = {c[0]: str(c[1]) for c in theirs.description}
    for field in ours.schema.fields:
        assert types[field.name] in KINDS[field.dataType], field
    order = [[c[0] for c in theirs.description].index(name) for name in columns]
    expected = sorted(comparable([row[i] for i in order]) for row in theirs.fetchall())
    assert sorted(comparable(row) for row in ours.select(*columns).collect()) == expected


def test_entry(spark):
    found = contract.entry(spark)
    assert found.count() > 0
    assert found.columns[0] == "item_id"


def test_runs_are_written_from_answers_that_were_kept(spark, monkeypatch):
    """However often records are written, the messages are cleaned and asked about once."""
    from postbag.plans import queries

    reads, kept = [], queries.pin
    monkeypatch.setattr(queries, "pin", lambda df, kind: reads.append(kind) or kept(df, kind))
    written, write = [], queries.write_records
    monkeypatch.setattr(queries, "write_records", lambda found, *a, **k: written.append(found.inputFiles()) or write(found, *a, **k))
    queries.run_records(spark, SMALL)
    assert reads == ["responses"] and all("responses-" in name for names in written for name in names) and len(written) == 3
