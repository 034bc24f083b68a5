"""Regions, boxes and borders of many maps at once, and narrow tables that grow to maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import outlines as O
from plumbline.functions.polygons import min_area_rect, min_area_rects
from plumbline.operators import probability_maps as M


def flooded(mask):
    out, k = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask).tolist():
        if not out[tuple(start)]:
            k, todo = k + 1, [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = k
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_regions_against_a_flood():
    rng = np.random.default_rng(4)
    for share in (0.1, 0.35, 0.6, 1.0):
        for _ in range(10):
            mask = rng.random((rng.integers(1, 20), rng.integers(1, 20))) < share
            assert (M.label_regions(mask) == flooded(mask)).all()
    comb = np.zeros((9, 41), bool)
    comb[:-1, ::2] = True
    comb[-1] = True
    assert M.label_regions(comb).max() == 1


def test_boxes_of_a_stack_are_those_of_its_maps():
    rng = np.random.default_rng(6)
    maps = np.repeat(np.repeat(rng.random((40, 6, 8)), 5, axis=1), 5, axis=2)
    settings = M.Settings(threshold=0.7, box_threshold=0.3, most_candidates=4)
    of, score, corners = M.boxes_of(maps, settings)
    one = [M.boxes_of(v[None], settings) for v in maps]
    assert of.tolist() == [i for i, (k, _, _) in enumerate(one) for _ in k] and len(of) > 40
    assert score.tolist() == [x for _, s, _ in one for x in s] and corners.tolist() == [x for _, _, c in one for x in c.tolist()]
    moved = M.boxes_of(maps, settings, np.tile([2.0, 0, 10, 0, 2, -10, 0, 0, 1], (len(maps), 1)))[2]
    assert abs(moved - (2 * corners + [10, -10])).max() <= 1
    sets = [rng.integers(0, 9, (n, 2)).astype(float) for n in (1, 2, 5, 9, 30)]
    for p, c, s, a in zip(sets, *min_area_rects(sets)):
        assert min_area_rect(p) == (tuple(c), tuple(s), a)


def test_maps_of_many_shapes(spark):
    rows = []
    for i in range(12):
        h, w = (20, 30) if i % 4 < 2 else (18, 24)
        v = np.full((h, w), 0.1)
        v[5:12, 6 : 16 + i % 3] = 0.9
        rows.append((i, h, w, (v if i % 5 else v * 0).ravel().tolist()))
    maps = spark.createDataFrame(rows, "image int, height int, width int, values array<double>").coalesce(1)
    got = {r.image: r for r in M.detect(maps).collect()}
    assert sorted(got) == [i for i in range(12) if i % 5] and {r.k for r in got.values()} == {1}
    for i, r in got.items():
        area, around = (9 + i % 3) * 6, 2 * (9 + i % 3 + 6)
        d = area * 1.5 / around
        assert r.score == pytest.approx(0.9) and r.flat == np.rint([6 - d, 5 - d, 15 + i % 3 + d, 5 - d, 15 + i % 3 + d, 11 + d, 6 - d, 11 + d]).tolist()
    with pytest.raises(Exception, match="another number of values"):
        M.detect(maps.withColumn("values", F.slice("values", 1, 7))).collect()


def test_borders_of_a_stack_are_those_of_its_masks():
    rng = np.random.default_rng(8)
    masks = rng.random((60, 9, 11)) < np.linspace(0, 1, 60)[:, None, None]
    of, hole, sizes, points = O.outlines_of(masks)
    one = [(i, h, p.tolist()) for i, m in enumerate(masks) for p, h in O.outlines(m)]
    assert list(zip(of.tolist(), hole.tolist())) == [(i, h) for i, h, _ in one] and hole.sum() > 20
    assert [p.tolist() for p in np.split(points, np.cumsum(sizes)[:-1])] == [p for _, _, p in one]


def test_traced_maps_keep_their_images(spark):
    rows = [(f"m{i}", 6, 7 + i % 2, [0.9 if i % 3 and 8 <= k < 11 else 0.1 for k in range(6 * (7 + i % 2))]) for i in range(9)]
    got = M.trace(spark.createDataFrame(rows, "image string, height int, width int, values array<float>").coalesce(1), 0.5).collect()
    assert sorted((r.image, r.k, r.hole) for r in got) == [(f"m{i}", 1, False) for i in range(9) if i % 3]
    assert {(r.image, *((p.x, p.y) for p in r.polygon)) for r in got} == {(f"m{i}", *(((1, 1), (3, 1)) if i % 2 == 0 else ((0, 1), (2, 1)))) for i in range(9) if i % 3}


@pytest.mark.parametrize("name", ["map_rectangles", "map_outlines", "map_polygons", "candidate_cap"])
def test_keys_are_dealt_before_they_grow(spark, sf_dir, name):
    from plumbline.plans import catalog

    out = catalog.queries()[name](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "lambdafunction" not in plan[plan.index("MapIn") : plan.index("REPARTITION_BY_NUM")]
