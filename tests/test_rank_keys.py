"""Ranks by keys of any type, over the table and in groups, against sorted lists."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranking, split

N = 900
KEYS = {
    "string": lambda i: None if i % 50 == 0 else "x" * 70 + f"é{(i * 7919) % 301:03d}",
    "date": lambda i: datetime.date(1990, 1, 1) + datetime.timedelta(days=(i * 7919) % 500),
    "timestamp": lambda i: datetime.datetime(1990, 1, 1) + datetime.timedelta(hours=(i * 7919) % 700),
    "binary": lambda i: bytes([(i * 31) % 256, i % 7]),
    "decimal(20,3)": lambda i: decimal.Decimal((i * 7919) % 4001) / 1000,
    "boolean": lambda i: i % 3 == 0,
    "double": lambda i: float("nan") if i % 40 == 0 else ((i * 7919) % 301) / 7,
}


def first(v):
    """Nulls first, NaN last."""
    return (v is not None, v != v, 0 if v is None or v != v else v)


@pytest.mark.parametrize("kind", KEYS)
def test_ranks(spark, kind):
    rows = [(i, i % 4, KEYS[kind](i)) for i in range(N)]
    df = spark.createDataFrame(rows, f"id long, g int, k {kind}")
    order = sorted(rows, key=lambda r: (first(bytes(r[2]) if isinstance(r[2], bytearray) else r[2]), r[0]))
    got = {r["id"]: r["rank"] for r in ranking.global_rank(df, ["k", "id"]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    got = {r["id"]: r["rank"] for r in ranking.rank_first(df, "k", ["id"], ["g"]).collect()}
    for g in range(4):
        assert [got[r[0]] for r in order if r[1] == g] == list(range(1, N // 4 + 1))
    alone = sorted(r["rank"] for r in ranking.global_rank(df, ["k"]).collect())
    assert alone == list(range(1, N + 1))


def test_picks_and_places(spark):
    rows = [(i, f"s{i % 3}", f"t{(i * 37) % 101:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    got = ranking.quantile_pick(df, ["s"], ["t", "id"], [0.0, 0.5, 1.0]).collect()
    for s in ("s0", "s1", "s2"):
        own = sorted((r[2], r[0]) for r in rows if r[1] == s)
        assert sorted((r["quantile"], r["id"]) for r in got if r["s"] == s) == [(q, own[round(q * (len(own) - 1))][1]) for q in (0.0, 0.5, 1.0)]
    ranks = {r["id"]: r["rank"] for r in ranking.average_rank(df, "t").collect()}
    for i, _, t in rows[:40]:
        below, equal = sum(r[2] < t for r in rows), sum(r[2] == t for r in rows)
        assert ranks[i] == below + (equal + 1) / 2
    assert len(split.weighted_sample(df, "s", 50).collect()) == 50


def test_one_value_is_spread(spark):
    """Rows that tie on the order are dealt to all ranges."""
    df = spark.range(200_000).select("id", F.lit("same").alias("k"))
    sizes = ranking.in_ranges(df, ["k"]).groupBy("__range").count().collect()
    assert len(sizes) >= 60 and max(r["count"] for r in sizes) < 3 * 200_000 / len(sizes)
    out = ranking.global_rank(df, ["k"]).agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(out) == (1, 200_000, 200_000)
