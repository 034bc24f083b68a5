"""Every registered query of the evaluation engine against its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str | bytes | list | dict):
            return str(v)
        if isinstance(v, datetime.date):
            return v.isoformat()[:10] if not isinstance(v, datetime.datetime) or v.time() == datetime.time() else v.isoformat()
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.5g}"

    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    sql = catalog.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        want = values([c[0] for c in got.description], got.fetchall())
        assert values(df.columns, rows) == want


def test_entry_has_all(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
