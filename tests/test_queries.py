"""Every query against its SQL on the smallest tables, and what the plans look like."""

import math
import os

import pytest

from tidemark.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, base, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = base.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    expected = [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
    assert sorted(names) == columns
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == sorted(tuple(plain(r[c]) for c in columns) for r in expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows_and_a_stable_schema(spark, name):
    first, second = registry.QUERIES[name](spark, SF), registry.QUERIES[name](spark, SF)
    assert first.count() > 0 and first.schema == second.schema


def test_entry_and_registry_work_without_the_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_overlaps_are_joined_by_keys(spark):
    text = plan(registry.QUERIES["drift_sliding"](spark, SF))
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from tidemark.plans.tables import stream

    text = plan(stream(spark, SF).where("t < 600").select("x"))
    assert "LessThan(event_id,600)" in text and "ReadSchema: struct<event_id:bigint,value:double>" in text
