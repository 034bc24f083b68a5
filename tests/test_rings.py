"""Which rings count as simple ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygons as P
from plumbline.operators import validate

RINGS = {
    "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], False), "closed square": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], False), "repeated point": ([(0, 0), (4, 0), (4, 0), (4, 4), (0, 4)], False),
    "straight corner": ([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], False), "concave": ([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], False), "triangle": ([(0, 0), (4, 0), (0, 4)], False),
    "bow": ([(0, 0), (4, 4), (4, 0), (0, 4)], True), "touches itself": ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], True), "point on point": ([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)], True),
    "overlapping edges": ([(0, 0), (6, 0), (6, 2), (4, 0), (2, 0), (0, 2)], True), "spike": ([(0, 0), (4, 0), (8, 0), (4, 0), (4, 4), (0, 4)], True), "spike out and back": ([(0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4)], True),
    "two points": ([(0, 0), (1, 1)], False), "empty": ([], False),
}


def test_rings(spark):
    rows = [(n, [{"x": float(x), "y": float(y)} for x, y in p]) for n, (p, _) in RINGS.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, polygon array<struct<x: double, y: double>>")
    got = {r["name"]: r["c"] for r in df.select("name", validate.self_crossing(F.col("polygon")).alias("c")).collect()}
    assert got == {n: c for n, (_, c) in RINGS.items()} | {"null": False}


def test_rows_of_polygons_equal_one_by_one(spark):
    """Areas and offsets of many polygons at once, shared and opposite borders, nulls and lines among them."""
    import numpy as np

    from plumbline.functions import polygons as P

    rng = np.random.default_rng(3)
    shapes = [rng.integers(-9, 9, (k, 2)).astype(float) for k in (3, 3, 4, 5) for _ in range(25)]
    star = lambda n: np.array([(10 + r * np.cos(t), 10 + r * np.sin(t)) for r, t in zip(rng.uniform(3, 9, n), np.arange(n) * 2 * np.pi / n, strict=True)])
    square = np.array([(0.0, 0), (4, 0), (4, 4), (0, 4)])
    shapes += [np.trunc(star(k)) for k in (3, 4, 5, 6) for _ in range(25)] + [square, square[::-1], square + (4, 0), square + (2, 0), square[:3], square[:2]]
    pairs = [(shapes[i], shapes[j]) for i, j in rng.integers(0, len(shapes), (300, 2))] + [(a, b) for a in shapes[-6:] for b in shapes[-6:]]
    points = lambda p: None if p is None else [(float(x), float(y)) for x, y in p]
    rows = [(i, points(a), points(b)) for i, (a, b) in enumerate(pairs)] + [(999, None, points(square))]
    df = spark.createDataFrame(rows, f"i int, a {P.POLYGON}, b {P.POLYGON}").select("i", P.polygon_intersection("a", "b").alias("area"), P.polygon_offset(F.col("a"), 1.5).alias("out"))
    got = {r.i: r for r in df.collect()}
    assert got[999].area is None and got[999].out is None
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i].area - P.intersection_area(a, b)) < 1e-6, (a, b)
        want = P.unclip(a, 1.5) if len(a) > 2 else a
        assert np.allclose([(p.x, p.y) for p in got[i].out], want)
    boxes = spark.createDataFrame([(points(square * (1, k)),) for k in (1, 2, 3)], f"p {P.POLYGON}")
    assert [tuple(r.a) for r in boxes.select(P.rectangle_of(F.col("p")).alias("a")).collect()] == [tuple(r.a) for r in boxes.select(P.polygon_rectangle("p").alias("a")).collect()]


def test_rectangles_of_many_rings(monkeypatch):
    """Convex rings are their own hulls, whichever way they run; folded, repeated and pointed ones are not."""
    rng = np.random.default_rng(5)
    rings = [rng.integers(0, 9, (n, 2)).astype(float) for n in (1, 2, 3, 4, 4, 6, 6)] + [np.array([[0, 0], [4, 0], [4, 0], [0, 3.0]])]
    star = np.array([[np.cos(t), np.sin(t)] for t in np.arange(5) * 4 * np.pi / 5])  # goes around twice
    convex = [np.array([[np.cos(t), 3 * np.sin(t)] for t in np.sort(rng.random(n) * 6.28)]) for n in (3, 4, 5, 9)]
    rings += [star, *convex, *(c[::-1] for c in convex), *(np.roll(c, 2, axis=0) for c in convex)]
    want = []
    for p in rings:
        h = P.hull(p)
        sides = [(b - a) / np.hypot(*(b - a)) for a, b in zip(h, np.roll(h, -1, axis=0))] if len(h) > 2 else []
        want.append(min((np.ptp(h @ u) * np.ptp(h @ (-u[1], u[0])) for u in sides), default=0.0))
    called = []
    monkeypatch.setattr(P, "hull", lambda p, hull=P.hull: called.append(p) or hull(p))
    got = P.min_area_rects(rings)[1]
    assert got.prod(axis=1) == pytest.approx(want)
    assert not any(p is c or (len(p) == len(c) and (p == c).all()) for p in called for c in rings[-12:]) and any((p == star).all() for p in called if len(p) == 5)


def test_boxes_meet_polygons(spark, monkeypatch):
    """Rings that are no boxes by their first corner give the pairs of boxes, also where both kinds meet; UDFs see no null lists."""
    box = lambda x0, x1, at: [((x0, 0.0), (x1, 0.0), (x1, 10.0), (x0, 10.0))[(i + at) % 4] for i in range(4)]
    gt, det = "image int, g int, polygon array<struct<x: double, y: double>>, dc boolean", "image int, d int, polygon array<struct<x: double, y: double>>"

    def pairs(turned):
        g = [(i, k, box(25.5 * k - 30, 25.5 * k + 8 * k, 2 if turned(k) else 0), i > 3 and k == 2) for i in range(6) for k in (1, 2, 3)]
        d = [(i, k, box(25.0 * k - 20 + i, 25.0 * k + 6.7 * k, 2 if turned(k + i) else 0)) for i in range(6) for k in (1, 2, 3)]
        got = P.polygon_pairs(spark.createDataFrame(g, gt), spark.createDataFrame(d, det)).collect()
        return {(r.image, r.g, r.d): (r.dc, r.gt_length, r.fp_length, pytest.approx(r.ap)) for r in got}, sum(len(r.hits) for r in got)

    boxes, hits = pairs(lambda k: False)
    assert boxes == pairs(lambda k: True)[0] == pairs(lambda k: k % 2 == 0)[0] and hits > 20

    def no_nulls(a, b):
        assert not a.null_count and not b.null_count
        import pyarrow as pa

        return pa.array([0.0] * len(a))

    monkeypatch.setattr(P, "polygon_intersection", F.arrow_udf(no_nulls, "double"))
    assert len(pairs(lambda k: False)[0]) == len(boxes)
