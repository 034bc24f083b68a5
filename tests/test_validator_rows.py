"""Polygon checks against a loop over rows, and what a task of them holds."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import polygons as P
from plumbline.operators import validate


def test_checks_against_a_loop(spark):
    rng = np.random.default_rng(9)
    nan = float("nan")
    special = [[(0.0, nan), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.5)], [(-0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], []]
    rows = []
    for _ in range(400):
        x, y = rng.integers(-3, 12, 2).tolist()
        p = special[rng.integers(len(special))] if rng.random() < 0.3 else [(float(x), float(y)), (x + 2.0, float(y)), (x + 2.0, y + 2.0), (float(x), y + 2.0)]
        rows.append((f"i{rng.integers(5)}" if rng.random() < 0.9 else None, p, 8.0 + len(rows) % 3))
    got = validate.polygon_checks(spark.createDataFrame(rows, f"image string, polygon {P.POLYGON}, size double"), F.col("size"), F.lit(9.0), tolerance=2.0, most=60).first()
    seen, n, again, over = {}, {}, 0, []
    for image, p, size in rows:
        key = (image, tuple(("nan" if math.isnan(v) else v + 0.0) for q in p for v in q))
        again += key in seen
        seen[key] = True
        n[image] = n.get(image, 0) + 1
        if p and not any(math.isnan(v) for q in p for v in q):
            xs, ys = zip(*p)
            over.append(max(0, -min(xs), -min(ys), max(xs) - (size - 1), max(ys) - 8))
    bad = sum(any(math.isnan(v) for q in p for v in q) for _, p, _ in rows)
    assert (got.images, got.polygons, got.duplicate_polygons, got.full_images) == (len(n), len(rows), again, sum(v > 60 for v in n.values()))
    assert (got.bad_numbers, got.short_polygons, got.outside, got.far_outside) == (bad, sum(len(p) < 4 for _, p, _ in rows), sum(v > 0 for v in over), sum(v > 2 for v in over))
    assert again > 100 and bad and got.invalid_geometry and got.far_outside and got.full_images


def test_no_table_of_polygons_is_held(spark, sf_dir):
    from plumbline.plans import catalog

    for name in ("polygon_validator", "broken_submission"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        keys = re.findall(r"Aggregate \[([^\[\]]*)\], \[", plan)  # those of aggregates with keys
        assert "Window [" in plan and not any("polygon" in k for k in keys)


def test_no_polygons(spark):
    none = spark.createDataFrame([], f"image string, polygon {P.POLYGON}")
    got = validate.passed(validate.polygon_checks(none, F.lit(9), F.lit(9))).first()
    assert (got.images, got.full_images, got.passed) == (0, 0, True)


def test_report_of_images_that_meet(spark):
    box = [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]
    other = [(x + 2, y) for x, y in box]
    rows = [(1, box), (1, other), (1, box), (2, None), (3, box), (5, None), (5, other), (None, box)]
    sent = spark.createDataFrame(rows, f"image int, polygon {P.POLYGON}")
    expected = spark.createDataFrame([(1,), (1,), (2,), (4,), (5,), (None,)], "image long")
    report = validate.submission_report(sent, expected, F.lit(9), F.lit(9))
    r = report.first()
    assert (r.rows, r.missing_images, r.extra_images, r.empty_images) == (5, 2, 2, 1)
    assert (r.least_polygons, r.most_polygons, r.mean_polygons, r.polygons, r.duplicate_polygons, r.passed) == (0, 3, 1.2, 6, 1, False)
    r = validate.submission_report(sent.where("false"), expected, F.lit(9), F.lit(9)).first()
    assert (r.rows, r.missing_images, r.extra_images, r.most_polygons, r.mean_polygons) == (0, 5, 0, 0, 0.0)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" not in plan
