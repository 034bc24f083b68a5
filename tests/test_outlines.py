"""Borders of bitmaps, simplification, round offsets and detection of polygons, held against known shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import outlines as O
from plumbline.functions.polygons import signed_area
from plumbline.operators import probability_maps as M


def drawn(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def shape_of(mask):
    return sorted((hole, sorted(map(tuple, p.tolist()))) for p, hole in O.outlines(mask))


def test_l_shape_and_dots():
    mask = drawn("#.....", "#.....", "#.....", "####..", "####..", ".....#")
    assert shape_of(mask) == [(False, sorted([(0, 0), (0, 2), (1, 3), (3, 3), (3, 4), (0, 4)])), (False, [(5, 5)])]
    assert shape_of(drawn("#", ".", "#")) == [(False, [(0, 0)]), (False, [(0, 2)])]
    assert shape_of(drawn("###")) == [(False, [(0, 0), (2, 0)])]
    assert shape_of(np.zeros((3, 4), bool)) == []


def test_ring_and_what_is_inside():
    mask = np.zeros((12, 14), bool)
    mask[1:11, 1:13] = True
    mask[3:9, 3:11] = False
    mask[5:7, 5:8] = True
    corners = [(2, 3), (3, 2), (10, 2), (11, 3), (11, 8), (10, 9), (3, 9), (2, 8)]
    assert shape_of(mask) == sorted([(False, [(1, 1), (1, 10), (12, 1), (12, 10)]), (True, sorted(corners)), (False, [(5, 5), (5, 6), (7, 5), (7, 6)])])


def test_borders_reach_every_border_pixel():
    rng = np.random.default_rng(5)
    for _ in range(30):
        mask = rng.random((15, 17)) < 0.6
        found = np.zeros_like(mask)
        for p, _ in O.outlines(mask):
            for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
                n = max(abs(x1 - x0), abs(y1 - y0), 1)
                for k in range(n + 1):
                    found[y0 + (y1 - y0) * k // n, x0 + (x1 - x0) * k // n] = True
        padded = np.pad(mask, 1)
        clear = ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])
        assert (found == (mask & clear)).all()


def test_simplified_is_within_the_tolerance():
    t = np.arange(400) * 2 * np.pi / 400
    p = np.stack([200 * np.cos(t), 100 * np.sin(t)], axis=1)
    q = O.simplified(p, 2.0)
    assert 8 <= len(q) < 60
    edges = list(zip(q, np.roll(q, -1, axis=0)))
    assert max(min(O._off_line(x[None], a, b)[0] for a, b in edges) for x in p) <= 2.0 + 1e-9
    assert len(O.simplified(np.array([[0, 0], [5, 0], [10, 0], [10, 7], [0, 7]]), 0.1)) == 4


@pytest.mark.parametrize("p", [[(0, 0), (30, 0), (30, 20), (0, 20)], [(0, 0), (40, 5), (35, 30), (10, 35)], [(0, 0), (50, 0), (20, 40)]])
def test_convex_offsets(p):
    p = np.array(p, float)
    for d in (0.5, 3.0, 12.0):
        out = O.round_offset(p, d, 0.001)
        assert signed_area(out) == pytest.approx(abs(signed_area(p)) + O.closed_length(p) * d + math.pi * d * d, rel=2e-3)
        back = O.round_offset(p[::-1], d, 0.001)
        assert signed_area(back) == pytest.approx(signed_area(out))
    inner = O.round_offset(p, -2.0)
    assert 0 < signed_area(inner) < abs(signed_area(p))
    assert O.round_offset(p, -40.0) is None


def test_inward_rectangle_and_concave_outlines():
    box = np.array([(0, 0), (30, 0), (30, 20), (0, 20)], float)
    assert signed_area(O.round_offset(box, -4.0)) == pytest.approx(22 * 12)
    assert O.round_offset(box, -10.5) is None
    u = np.array([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)], float)
    wide = O.round_offset(u, 6.0, 0.001)  # closes the gap between the arms
    hull = 30 * 30 + 4 * 30 * 6 + math.pi * 36
    assert abs(signed_area(u)) < signed_area(wide) < hull
    y, x = np.mgrid[-12.125:43:0.25, -12.125:43:0.25]
    a, b = u, np.roll(u, -1, axis=0)
    d = np.full(x.shape, np.inf)
    for p, q in zip(a, b):
        t = np.clip(((x - p[0]) * (q - p)[0] + (y - p[1]) * (q - p)[1]) / ((q - p) @ (q - p)), 0, 1)
        d = np.minimum(d, np.hypot(x - p[0] - t * (q - p)[0], y - p[1] - t * (q - p)[1]))
    held = O._winding(np.stack([x.ravel(), y.ravel()], axis=1), a, b).reshape(x.shape) != 0
    near = (d <= 6) | held
    assert signed_area(wide) == pytest.approx(near.sum() / 16, rel=0.01)
    thin = O.round_offset(u, -4.0, 0.001)
    assert signed_area(thin) == pytest.approx(((d >= 4) & held).sum() / 16, rel=0.03)


def test_polygons_of_maps(spark):
    v = np.full((60, 80), 0.1, np.float32)
    v[10:40, 10:20] = 0.9
    v[30:40, 10:60] = 0.9
    v[50:52, 70:72] = 0.9
    maps = spark.createDataFrame([(7, 60, 80, v.ravel().tolist(), [2.0, 0.0, 5.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0])], "image long, height int, width int, values array<float>, matrix array<double>")
    settings = M.Settings(threshold=0.5, box_threshold=0.5, unclip_ratio=0.5)
    got = M.detect_polygons(maps.drop("matrix"), settings).collect()
    assert [(r["image"], r["k"]) for r in got] == [(7, 1)] and got[0]["score"] == pytest.approx(0.9)
    p = np.array([(q["x"], q["y"]) for q in got[0]["polygon"]])
    area, length = 49 * 29 - 39 * 20 - 0.5, 2 * (49 + 29) - 2 + math.sqrt(2)
    d = area * 0.5 / length
    assert signed_area(p) == pytest.approx(area + length * d + math.pi * d * d, rel=0.05)
    moved = np.array([(q["x"], q["y"]) for q in M.detect_polygons(maps, settings).collect()[0]["polygon"]])
    assert abs(moved - (2 * p + [5, 1])).max() <= 2
    assert [r["hole"] for r in M.trace(maps, 0.5).collect()] == [False, False]
    assert M.trace(maps.where("false")).collect() == []


def test_alignment_against_a_loop(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((20, 24)), rng.random((13, 15))
    ma, mb = np.array([[2.0, 0, 1], [0, 2.0, -3], [0, 0, 1]]), np.array([[3.1, 0.1, -2], [0.05, 3.0, 1], [0.0005, 0, 1]])
    width, height = 45, 35

    def sample(v, x, y):
        x0, y0 = math.floor(x), math.floor(y)
        at = lambda i, j: v[i, j] if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] else 0.0
        fx, fy = x - x0, y - y0
        return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy

    want = np.zeros(a.shape)
    masks = [M.content_mask(*v.shape, m, width, height) for v, m in ((a, ma), (b, mb))]
    assert masks[0].sum() and masks[1].sum() and not masks[0].all()
    for y in range(20):
        for x in range(24):
            top = low = 0.0
            for v, m, mask in ((a, ma, masks[0]), (b, mb, masks[1])):
                s = np.linalg.inv(np.linalg.inv(ma) @ m) @ [x, y, 1]
                sx, sy = s[0] / s[2], s[1] / s[2]
                i, j = round(sy), round(sx)
                k = mask[i, j] if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] else 0.0
                top += sample(v, sx, sy) * k
                low += k
            want[y, x] = top / low if low else 0.0
    rows = [(1, k, *v.shape, v.ravel().tolist(), m.ravel().tolist(), width, height) for k, (v, m) in enumerate(((a, ma), (b, mb)))]
    df = spark.createDataFrame(rows, "image long, k int, height int, width int, values array<double>, matrix array<double>, original_width int, original_height int")
    got = M.fuse_aligned(df).first()
    assert np.allclose(np.array(got["values"]).reshape(20, 24), want, atol=1e-9)


def test_offset_column(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 1.0), (2, None, 1.0), (3, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], -3.0)], "i long, p array<struct<x: double, y: double>>, d double")
    got = {r["i"]: r["q"] for r in df.select("i", O.polygon_round_offset(F.col("p"), F.col("d")).alias("q")).collect()}
    assert got[2] is None and got[3] is None and signed_area(np.array([tuple(q) for q in got[1]])) > 16 + 16


def test_a_cover_holds_its_border():
    """Pixels in or on a ring, whichever way it runs: crossings of later edges don't take border pixels out."""
    for p, n in (([[0, 0], [4, 0], [4, 3], [0, 3]], 20), ([[1, 1], [6, 1], [6, 3], [3, 3], [3, 6], [1, 6]], 27)):
        for q in (np.array(p, float), np.array(p[::-1], float)):
            assert len(O.covered_pixels(q, 9, 9)[0]) == n
            v = np.zeros((1, 9, 9))
            v[0][O.covered_pixels(q, 9, 9)] = 1.0
            assert O.covered_means(q, np.array([len(q)]), np.zeros(1, int), v).tolist() == [1.0]


def test_rings_together_are_as_alone():
    rng = np.random.default_rng(3)
    rings = [rng.integers(0, 30, (n, 2)).astype(float) for n in rng.integers(3, 9, 80)]
    sizes, by = np.array([len(r) for r in rings]), rng.integers(-5, 7, 80).astype(float)
    for p, d, q in zip(rings, by, O.round_offsets(np.concatenate(rings), sizes, by), strict=True):
        alone = O.round_offset(p, d)
        assert (q is None) == (alone is None) and (q is None or (q == alone).all())
    points, many = O.simplified_rings(np.concatenate(rings), sizes, by)
    for p, d, q in zip(rings, by, np.split(points, np.cumsum(many)[:-1]), strict=True):
        assert (O.simplified(p, d) == q).all()


def test_polygons_of_a_stack_are_those_of_its_maps():
    rng = np.random.default_rng(6)
    maps = np.repeat(np.repeat(rng.random((20, 6, 8)), 5, axis=1), 5, axis=2)
    settings = M.Settings(threshold=0.5, box_threshold=0.3, most_candidates=4, least_side=1.0)
    of, score, polygons = M.polygons_of(maps, settings, np.tile([2.0, 0, 10, 0, 2, -10, 0, 0, 1], (20, 1)))
    alone = [(i, M.polygons_of(v[None], settings, np.array([[2.0, 0, 10, 0, 2, -10, 0, 0, 1]]))) for i, v in enumerate(maps)]
    assert of.tolist() == [i for i, (k, _, _) in alone for _ in k] and len(of) > 20
    assert score.tolist() == pytest.approx([x for _, (_, s, _) in alone for x in s])
    assert [p.tolist() for p in polygons] == [p.tolist() for _, (_, _, q) in alone for p in q]
