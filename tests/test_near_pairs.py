"""Bands of near_pairs: pairs at the very distance."""

import numpy as np

from plumbline.operators import split


def test_bands_lose_no_pair(spark):
    rng = np.random.default_rng(0)
    hashes = [0, 0x0101010101010101]
    for most in (8, 8, 8, 8):
        x = int(rng.integers(0, 1 << 62))
        hashes += [x, x ^ sum(1 << 8 * i + int(rng.integers(0, 7)) for i in range(most))]
    rows = [(i, h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "key long, phash long")
    for most in (0, 3, 8, 11):
        want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= most}
        assert {tuple(r) for r in split.near_pairs(df, "key", "phash", most).collect()} == want


def test_few_pairs_are_compared(spark):
    """Uniform hashes: under 2 % of all pairs meet, and none that is near is lost."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 2000, np.int64)
    near = base[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in range(200)], np.int64)
    rows = [(i, int(h)) for i, h in enumerate(np.concatenate((base, near)))]
    df = spark.createDataFrame(rows, "key long, phash long")
    n = len(rows)
    met = split.near_candidates(df, "key", "phash", 8, 64)
    assert met.count() <= 0.02 * n * (n - 1) / 2
    assert met.select("left", "right").distinct().count() == met.count()
    h = np.array([r[1] for r in rows])
    want = {(i, int(j)) for i in range(n) for j in np.nonzero(np.bitwise_count((h[i] ^ h[i + 1 :]).view(np.uint64)) <= 8)[0] + i + 1}
    assert {(r[0], r[1]) for r in split.near_pairs(df, "key", "phash", 8).collect()} == want


def test_copies_give_all_their_pairs(spark):
    rows = [(1, 5), (2, 5), (3, 5), (4, 4), (5, 4), (6, -1), (7, None)]
    df = spark.createDataFrame(rows, "key long, phash long")
    want = {(a, b, 0 if x == y else 1) for a, x in rows[:5] for b, y in rows[:5] if a < b}
    got = [tuple(r) for r in split.every_near_pair(df, "key", "phash", 8).collect()]
    assert set(got) == want and len(got) == len(want)


def test_blocks_give_the_pairs_of_the_index(spark, monkeypatch):
    """Uneven bits: the index would compare most pairs, blocks meet in its place."""
    monkeypatch.setattr(split, "BLOCK", 400)
    rng = np.random.default_rng(2)
    hashes = [sum(1 << i for i in range(63) if x[i]) for x in rng.random((900, 64)) < 0.1]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "key int, phash long")
    groups = df.withColumnRenamed("key", "head")
    assert split.compared_share(groups, "phash", 8, 64) > 0.3
    got = {tuple(r) for r in split.near_pairs(df, "key", "phash", 8).collect()}
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(900) for b in range(a + 1, 900)}
    first = {h: hashes.index(h) for h in hashes}
    assert got == {(a, b, d) for a, b, d in want if d <= 8 and (a == first[hashes[a]] and (b == first[hashes[b]] or d == 0))}


def test_pairs_are_not_broadcast(spark, monkeypatch):
    """Pairs outgrow the hashes by which their size is judged: none go through the driver."""
    monkeypatch.setattr(split, "BLOCK", 400)
    rng = np.random.default_rng(2)
    hashes = [sum(1 << i for i in range(63) if x[i]) for x in rng.random((900, 64)) < 0.1]
    rows = list(enumerate(hashes + hashes[:50]))
    out = split.every_near_pair(spark.createDataFrame(rows, "key long, phash long"), "key", "phash", 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan[: plan.index("MapInArrow")]
    got = [tuple(r) for r in out.collect()]
    assert set(got) == {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 8} and len(got) == len(set(got))
