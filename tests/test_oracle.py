"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from sparkloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def canonical(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v

    return sorted(repr(tuple(value(v) for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(name, spark, small_dir, duck):
    got = registry.QUERIES[name](spark, small_dir)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = found.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert canonical(rows) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
