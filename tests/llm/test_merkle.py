"""The Merkle manifest against plain loops, at sizes around the tiers, on odd and empty tables."""

import pytest

from plumbline.llm import merkle
from plumbline.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def check(df):
    got = sorted(map(tuple, merkle.manifest(df).collect()), key=str)
    assert got == sorted(merkle.brute_force([tuple(r) for r in df.select(*COLUMNS).collect()]), key=str)
    return got


def test_table(spark, sf_dir):
    got = check(read_table(spark, sf_dir, "documents"))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 4097])
def test_sizes(spark, n):
    """Groups that end at, before and after a tier."""
    got = check(spark.createDataFrame([(i, "t", "en", "s", i, "x", 0) for i in range(n)], SCHEMA))
    assert len(got) == n and len({r[3] for r in got}) == 1


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and ids, the largest long, clashing names, many groups."""
    rows = [(i, None if i % 5 == 0 else f"t{i % 50}", [None, "b", "a", "é", "", "-", "="][i % 7 if i < 40 else 1], None if i % 3 else "s", None if i % 4 == 0 else i, "x", 3) for i in range(200)]
    rows += [rows[3], rows[3], (3, "other", "b", None, 1, "", 1), (None,) * 7, (2**63 - 1, "z", "zz", "q", 2**63 - 1, "", 1), (5, "🎉" * 50_000, "b", "s", 2, "", 0)]
    rows += [(i, "t", f"group {i % 90}", "s", 1, "", 0) for i in range(1000, 1200)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_empty(spark):
    assert check(spark.createDataFrame([], SCHEMA)) == []
