"""Vector codes against a plain loop: the table, ties, huge numbers, odd and empty tables."""

import math

import numpy as np
import pytest

from plumbline.llm import vector_codes as vc
from plumbline.llm.common import read_table

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long"


def checked(df, vectors):
    books, want = vc.brute_force(vectors)
    rows = df.collect()
    assert {r["codebooks_sha256"] for r in rows} == {books.sha256()}
    for r in rows:
        code, error = want[r["vec_id"]]
        assert (r["code"], r["error"]) == (code, min(error, vc.MOST))
    sums = {}
    for r in rows:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    return rows, sums


def test_table_equals_loop(spark, sf_dir):
    src = read_table(spark, sf_dir, "embeddings")
    vectors = [(r["vec_id"], r["embedding"]) for r in src.collect()]
    labels = {r["vec_id"]: r["label"] for r in src.collect()}
    rows, _ = checked(vc.compress(src).join(src.select("vec_id", "label"), "vec_id"), vectors)
    assert len(rows) == len(vectors)
    sums = {}
    for r in rows:
        sums[labels[r["vec_id"]]] = sums.get(labels[r["vec_id"]], 0) + r["error"]
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in rows)


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e9, 1e40])
def test_nearest_is_exact(spread):
    """Annuli miss nothing, whatever the size of the numbers; ties go to the lower index."""
    rng = np.random.default_rng(7)
    for width in (1, 3, 16):
        entries = vc.integers(rng.normal(size=(60, width)) * spread)
        entries[40:] = entries[:20]  # equal entries
        x = vc.integers(np.concatenate((rng.normal(size=(1200, width)) * spread, rng.normal(size=(60, width)) * spread * 3)))
        x[:20] = entries[:20]
        at, least = vc.nearest(x, entries)
        for k in [*range(0, 60), *range(60, len(x), 37)]:
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[k], e)) for e in entries]
            assert (int(least[k]), int(at[k])) == min((v, i) for i, v in enumerate(d))


def test_integers_are_floors():
    x = np.array([0.0, -0.0, 1 / 1024, -1 / 1025, 0.9999, 5e-324, -5e-324, 1e300, -1.7e308])
    assert [int(v) for v in vc.integers(x)] == [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in x]


def test_odd_rows(spark):
    near = [(i, [i / 7, -i / 3, 1.0, float(i % 5)], i % 3 or None, "x", 5) for i in range(300)]
    odd = [(900, None, 1, "x", 1), (901, [1.0, None, 2.0, 3.0], 1, None, None), (902, [math.nan, 1.0, 1.0, 1.0], 1, "", 0), (903, [math.inf, 1.0, 1.0, 1.0], 1, "", 0), (904, [1.0], 1, "", 0), (905, [], 2, "", 0)]
    huge = [(500, [1e300, -1e300, 3.0, 1.7e308], 7, "x", 1), (501, [-1.5, 2.0**61, 2.5, 1e18], 7, "x", 1)]
    df = spark.createDataFrame(near + odd + huge, SCHEMA)
    vectors = [(r[0], r[1]) for r in near + huge]
    rows, _ = checked(vc.compress(df).join(df.select("vec_id", "label"), "vec_id"), vectors)
    assert len(rows) == len(vectors)
    repeated = vc.compress(spark.createDataFrame([near[1], near[1], (None, near[2][1], None, "", 0)], SCHEMA)).collect()
    assert [r["code"] for r in repeated if r["vec_id"] == 1] == ["00000000"] * 2 and len(repeated) == 3
    assert vc.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.compress(spark.createDataFrame(odd[:4], SCHEMA)).collect() == []


def test_codes_decode(spark):
    rows = [(i, [i / 50, 1.0, -1.0, i / 9], 0, "", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    books, _ = vc.brute_force([r[:2] for r in rows])
    for r in vc.compress(df).collect():
        x = [math.floor(1024 * v) for v in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(x, vc.decode(r["code"], books))) == r["error"]
