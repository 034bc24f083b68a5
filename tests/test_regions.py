"""Don't-care areas, image features and fingerprints, validators and settings, on values worked out by hand."""

import numpy as np
import pytest

from plumbline.functions import geometry as G
from plumbline.operators import cleval, images, probability_maps, validate


def test_covered_area(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows, want = [], []
    for i in range(40):
        boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(*rng.integers(0, 12, (2, i % 6)), *rng.integers(1, 9, (2, i % 6)), strict=True)]
        grid = np.zeros((24, 24), bool)
        for x0, y0, x1, y1 in boxes:
            grid[x0:x1, y0:y1] = True
        rows.append((i, [tuple(map(float, b)) for b in boxes]))
        want.append(float(grid.sum()))
    df = spark.createDataFrame(rows, "i int, b array<struct<x0: double, y0: double, x1: double, y1: double>>")
    assert [r.a for r in df.select("i", G.covered_area(F.col("b")).alias("a")).orderBy("i").collect()] == want


def test_ground_truth_takes_its_share_of_a_dont_care_region(spark):
    """A detection over a don't-care region: swallowed by it, unless ground truth lies there."""
    gt = "image int, g int, x0 double, y0 double, x1 double, y1 double, dc boolean"
    det = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 10.0), (2, 1, 0.0, 0.0, 100.0, 10.0)], "image int, d int, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 1, 0.0, 0.0, 40.0, 10.0, True), (2, 1, 0.0, 0.0, 40.0, 10.0, True), (2, 2, 10.0, 0.0, 30.0, 10.0, False)]
    got = {(r.image, r.g): r.ap for r in cleval.box_pairs(spark.createDataFrame(rows, gt), det).collect()}
    assert got == {(1, 1): pytest.approx(0.4), (2, 1): pytest.approx(0.2), (2, 2): pytest.approx(0.2)}
    per = {r.image: r for r in cleval.evaluate_boxes(spark.createDataFrame(rows, gt), det).collect()}
    assert per[1].fp == 0 and per[2].fp > 0


def test_shrinking_takes_area_means():
    x = np.arange(16.0).reshape(4, 4)
    assert images.shrink(x, 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert images.shrink(np.array([[0.0, 3.0, 6.0]]), 1, 2).tolist() == [[1.0, 5.0]]  # the middle pixel counts half on each side
    rng = np.random.default_rng(0)
    big = rng.integers(0, 256, (700, 1100)).astype(float)
    assert images.shrink(big, 326, 512).mean() == pytest.approx(big.mean())
    assert images.gray_vector(big).shape == (128 * 128,)


def test_features_of_large_images():
    half = np.zeros((600, 1200, 1), np.uint8)
    half[:, 600:] = 255
    f = images.features_of(half)
    assert f["brightness"] == pytest.approx(0.5) and f["contrast"] == pytest.approx(0.5) and f["dark_fraction"] == f["bright_fraction"] == 0.5
    red = np.zeros((10, 10, 3), np.uint8)
    red[..., 0] = 200
    assert images.features_of(red)["saturation"] == 1.0
    noise = np.random.default_rng(0).integers(0, 256, (1024, 1024, 1)).astype(np.uint8)
    assert images.features_of(noise)["contrast"] == pytest.approx(np.std(images.shrink(noise[..., 0].astype(float), 512, 512).round()) / 255)


def test_hashes_of_enlarged_images_agree():
    x = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(float)
    assert images.perceptual_hash(np.kron(x, np.ones((20, 20)))) == images.perceptual_hash(x)


def test_settings_have_to_agree():
    validate.same_settings({"threshold": 0.3}, {"threshold": 0.3})
    with pytest.raises(validate.ContractError):
        validate.same_settings({"threshold": 0.3}, {"threshold": 0.2})


def test_fusion_takes_the_size_of_the_first_scale(spark):
    rows = [("a", 2, 4, 4, [1.0] * 16, [1.0] * 16), ("a", 1, 2, 2, [0.0, 0.5, 0.0, 0.5], [1.0, 1.0, 0.0, 1.0]), ("b", 1, 1, 1, [0.7], [0.0])]
    maps = spark.createDataFrame(rows, "image string, k int, height int, width int, values array<double>, mask array<double>")
    got = {r.image: r for r in probability_maps.fuse(maps).collect()}
    assert got["a"].values == pytest.approx([0.5, 0.75, 1.0, 0.75]) and got["b"].values == [0.0]


def test_remainder_area():
    from plumbline.functions import polygons

    box = lambda x0, y0, x1, y1: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    assert polygons.remainder_area(box(0, 0, 10, 10), box(5, 0, 15, 10), [box(5, 0, 7, 10), box(6, 5, 9, 20)]) == pytest.approx(50 - 20 - 10)
    triangle = np.array([(0, 0), (10, 0), (0, 10)], float)
    assert polygons.remainder_area(triangle, box(0, 0, 10, 10), [box(0, 0, 5, 5)]) == pytest.approx(25)
    assert polygons.remainder_area(triangle, triangle[::-1], [box(20, 20, 30, 30)]) == pytest.approx(50)
    rng = np.random.default_rng(2)
    for _ in range(30):
        p, q = (np.round(rng.uniform(0, 20, (3, 2))) for _ in range(2))
        assert polygons.remainder_area(p, q, []) == pytest.approx(polygons.intersection_area(p, q), abs=1e-6)


def test_hits_of_boxes_are_those_of_their_polygons(spark):
    """Hits from closed forms against the characters' centres, also where truncation moves the heights."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    box = lambda: (float(x := rng.uniform(0, 30)), float(y := rng.uniform(0, 12)), float(x + rng.uniform(1, 60)), float(y + rng.uniform(1, 60)))
    gt = spark.createDataFrame([(i % 20, i, *box(), False) for i in range(120)] + [(0, 500, 1.0, 0.5, 2.0, 0.9, False)], "image int, g int, x0 double, y0 double, x1 double, y1 double, dc boolean")
    det = spark.createDataFrame([(i % 20, i, *box()) for i in range(120)] + [(0, 500, 0.0, 0.0, 9.0, 1.0)], "image int, d int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.g, r.d): list(r.hits) for r in cleval.box_pairs(gt, det).collect()}
    c = gt.select("image", "g", G.character_centres(G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), cleval.gt_length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("c"))
    for r in c.join(det, "image").collect():
        if (r.g, r.d) in got:
            x0, y0, x1, y1 = map(int, (r.x0, r.y0, r.x1, r.y1))
            assert got[r.g, r.d] == [i for i, p in enumerate(r.c) if x0 <= p.x < x1 and y0 <= p.y < y1], (r.g, r.d)
    assert sum(map(len, got.values())) > 200
    plan = cleval.sweep_boxes(gt, det.withColumn("score", F.lit(0.5)), "score", [0.0, 0.3])._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(threshold" not in plan
