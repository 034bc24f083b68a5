"""Queries with SQL against DuckDB on the test tables."""

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from plumbline.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in got.description)
    want = sorted(tuple(dict(zip((c[0] for c in got.description), r, strict=True))[n] for n in names) for r in got.fetchall())
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want
