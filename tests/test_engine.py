"""Geometry, evaluation, sources, sinks, contracts and the operators without SQL, on small fixtures."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import polygons as P
from plumbline.functions import scalar as S
from plumbline.operators import cleval, compare, probability_maps, ranking, split, validate
from plumbline.sources import annotations, sinks
from plumbline.streaming.metric_state import running_scores

GT = "image string, g long, x0 double, y0 double, x1 double, y1 double, dc boolean"
DET = "image string, d long, x0 double, y0 double, x1 double, y1 double"


def box(x0, x1, y0=0.0, y1=10.0):
    return [float(x0), float(y0), float(x1), float(y1)]


def evaluate(spark, gt, det):
    g = spark.createDataFrame([("a", i, *b[:4], len(b) > 4) for i, b in enumerate(gt)], GT)
    d = spark.createDataFrame([("a", i, *b) for i, b in enumerate(det)], DET)
    return cleval.evaluate_boxes(g, d).first()


def test_one_to_one(spark):
    r = evaluate(spark, [box(0, 40)], [box(0, 40)])
    assert (r.recall, r.precision, r.hmean, r.tp, r.n_gt) == (1, 1, 1, 4, 4)


def test_split_and_merge(spark):
    r = evaluate(spark, [box(0, 40)], [box(0, 20), box(20, 40)])
    assert (r.n_split, r.gran_recall, r.n_merged, r.tp) == (1, 1, 0, 4) and r.recall == 0.75
    r = evaluate(spark, [box(0, 40), box(40, 80)], [box(0, 80)])
    assert (r.n_merged, r.gran_precision, r.n_split, r.tp) == (1, 1, 0, 8) and r.precision == 7 / 8


def test_missing_sides(spark):
    r = evaluate(spark, [], [box(0, 40)])
    assert (r.recall, r.precision, r.fp, r.n_det) == (0, 0, r.fp, r.fp) and r.fp > 0
    r = evaluate(spark, [box(0, 40)], [])
    assert (r.recall, r.precision, r.hmean, r.n_gt) == (0, 0, 0, 4)


def test_dont_care_and_overlap(spark):
    r = evaluate(spark, [[*box(0, 40), True]], [box(0, 40)])
    assert (r.n_gt, r.n_det, r.fp) == (0, 0, 0)
    r = evaluate(spark, [box(0, 40)], [box(0, 40), box(0, 40)])
    assert r.overlapped > 0 and r.n_det == r.tp + r.overlapped + r.fp


def loop_evaluation(gt, det):
    """The same rules as loops over one image."""
    g_len = [int(min(100, np.rint(0.5 + max(a, 1 / (a + S.EPS))))) for a in (min(100, (b[3] - b[1]) / (b[2] - b[0] + S.EPS)) for b in gt)]
    f_len = [int(min(100, np.rint(0.5 + 1 / (S.EPS + min(100, (b[3] - b[1]) / (b[2] - b[0] + S.EPS)))))) for b in det]
    ap, hits = {}, {}
    for i, j in itertools.product(range(len(gt)), range(len(det))):
        a, b = [np.trunc(v) for v in gt[i][:4]], [np.trunc(v) for v in det[j]]
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        if len(gt[i]) > 4:  # what ground truth covers is no part of a don't-care region
            cells = np.zeros((200, 60), bool)
            cells[int(max(a[0], b[0])) : int(min(a[2], b[2])), int(max(a[1], b[1])) : int(min(a[3], b[3]))] = both > 0
            for other in gt:
                if len(other) == 4:
                    x0, y0, x1, y1 = (int(v) for v in other)
                    cells[x0:x1, y0:y1] = False
            both = float(cells.sum())
        size = (b[2] - b[0]) * (b[3] - b[1])
        ap[i, j] = both / size if size > 0 else 0
        n = g_len[i]
        xs = [gt[i][0] if c == 0 else gt[i][2] if c == n else np.trunc(gt[i][0] + (gt[i][2] - gt[i][0]) / n * c) for c in range(n + 1)]
        ys = [(gt[i][1], gt[i][3]) if c in (0, n) else (np.trunc(gt[i][1]), np.trunc(gt[i][3])) for c in range(n + 1)]
        mids = [((xs[c] + xs[c + 1]) / 2, sum((*ys[c], *ys[c + 1])) / 4) for c in range(n)]
        hits[i, j] = {c for c, (x, y) in enumerate(mids) if b[0] <= x < b[2] and b[1] <= y < b[3]}
    dc = [len(b) > 4 for b in gt]
    ok = lambda i, j: np.float32(ap[i, j]) >= np.float32(0.3)
    det_dc = [any(dc[i] and ok(i, j) for i in range(len(gt))) or sum(ap[i, j] for i in range(len(gt)) if dc[i] and hits[i, j]) >= 0.3 for j in range(len(det))]
    strong = {k for k in ap if ok(*k) and hits[k]}
    G_, D_ = [i for i in range(len(gt)) if not dc[i]], [j for j in range(len(det)) if not det_dc[j]]
    matched = set()
    for i, j in itertools.product(G_, D_):
        if (i, j) in strong and sum((i, y) in strong for y in range(len(det))) == 1 and sum((x, j) in strong for x in range(len(gt))) == 1:
            matched.add((i, j))
    for i in G_:
        found = [j for j in D_ if (i, j) in strong]
        matched |= {(i, j) for j in found} if len(found) > 1 else set()
    for j in D_:
        found = [i for i in G_ if hits[i, j]]
        matched |= {(i, j) for i in found} if len(found) > 1 and sum(ap[i, j] for i in found) >= 0.3 else set()
    tp = sum(len(set().union(*(hits[k] for k in matched if k[0] == i))) for i in G_)
    every = sum(len(hits[k]) for k in matched)
    fp = sum(f_len[j] for j in D_ if not any(k[1] == j for k in matched))
    pieces = [sum(k[0] == i for k in matched) for i in G_]
    merged = [sum(k[1] == j for k in matched) for j in D_]
    return sum(g_len[i] for i in G_), tp + every - tp + fp, tp, fp, every - tp, sum(max(0, p - 1) for p in pieces), sum(max(0, p - 1) for p in merged), sum(p > 1 for p in pieces), sum(p > 1 for p in merged)


def test_evaluation_against_loops(spark):
    rng = np.random.default_rng(0)
    images = {}
    for k in range(60):
        make = lambda n: [box(x, x + w, y, y + h) for x, w, y, h in zip(rng.uniform(0, 80, n), rng.uniform(3, 60, n), rng.uniform(0, 15, n), rng.uniform(4, 20, n), strict=True)]  # noqa: B023, E731
        images[f"i{k}"] = ([b + [True] if rng.random() < 0.2 else b for b in make(rng.integers(0, 6))], make(rng.integers(0, 6)))
    g = spark.createDataFrame([(k, i, *b[:4], len(b) > 4) for k, (gt, _) in images.items() for i, b in enumerate(gt)], GT)
    d = spark.createDataFrame([(k, i, *b) for k, (_, det) in images.items() for i, b in enumerate(det)], DET)
    got = {r.image: (r.n_gt, r.n_det, r.tp, r.fp, r.overlapped, r.gran_recall, r.gran_precision, r.n_split, r.n_merged) for r in cleval.evaluate_boxes(g, d).collect()}
    assert got == {k: loop_evaluation(*v) for k, v in images.items() if v[0] or v[1]}
    # boxes as general polygons, where the hull rule sets the same base edge
    poly = lambda df: df.withColumn("polygon", G.box_polygon(*map(F.col, ("x0", "y0", "x1", "y1"))))
    same = {r.image: (r.n_gt, r.tp, r.overlapped, r.n_split, r.n_merged) for r in P.evaluate_polygons(poly(g), poly(d)).collect()}
    assert same == {k: (v[0], v[2], v[4], v[7], v[8]) for k, v in got.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=12), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=12))
def test_polygon_clipping(a, b):
    p, q = P.hull(np.array(a, float)), P.hull(np.array(b, float))
    if len(p) < 3 or len(q) < 3:
        return
    area = P.intersection_area(p, q)
    assert -1e-6 <= area <= min(abs(P.signed_area(p)), abs(P.signed_area(q))) + 1e-6
    assert np.isclose(area, P.intersection_area(q[::-1], p), atol=1e-6)
    assert np.isclose(P.intersection_area(p, p), abs(P.signed_area(p)), atol=1e-6)
    (_, (w, h), _) = P.min_area_rect(p)
    assert w * h >= abs(P.signed_area(p)) - 1e-6


def test_concave_clipping():
    arrow = np.array([(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)], float)
    square = np.array([(0, 4), (10, 4), (10, 10), (0, 10)], float)
    grid = [(x + 0.5) / 20 for x in range(200)]
    inside = lambda poly, x, y: sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(poly, np.roll(poly, -1, axis=0), strict=True)) % 2
    want = sum(inside(arrow, x, y) and inside(square, x, y) for x in grid for y in grid) / 400
    assert abs(P.intersection_area(arrow, square) - want) < 0.2


def test_geometry_expressions(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)], [(0.0, 0.0), (10.0, 5.0), (10.0, 0.0), (0.0, 5.0)])], f"p {P.POLYGON}, bow {P.POLYGON}")
    r = df.select(
        G.area(F.col("p")).alias("area"), G.perimeter(F.col("p")).alias("per"), G.contains(F.col("p"), F.lit(0.0), F.lit(0.0)).alias("corner"), G.contains(F.col("p"), F.lit(10.0), F.lit(2.0)).alias("right"),
        G.flatten_polygon(F.col("p")).alias("flat"), G.unflatten_polygon(G.flatten_polygon(F.col("p"))).alias("back"), F.col("p"), validate.self_crossing(F.col("bow")).alias("bow"), validate.self_crossing(F.col("p")).alias("plain"),
        G.inverse_matrix(F.lit(200.0), F.lit(100.0), 640).alias("m"), G.overshoot(F.col("p"), F.lit(8), F.lit(8)).alias("over"), F.size(G.quad_centres(F.col("p"), F.lit(3), F.lit(False))).alias("quad"),
    ).first()
    assert (r.area, r.per, r.corner, r.right, r.over, r.bow, r.plain, r.quad) == (50, 30, True, False, 3, True, False, 3)
    assert r.flat == [0, 0, 10, 0, 10, 5, 0, 5] and r.back == r.p
    m = np.array(r.m).reshape(3, 3)
    assert np.allclose(m @ [0, 160, 1], [0, 0, 1]) and np.allclose(m @ [640, 480, 1], [200, 100, 1])


def test_scalars(spark):
    r = spark.createDataFrame([(1.0, 0.0, 12345, [1.0, float("nan")])], "a double, b double, n int, v array<double>").select(
        S.safe_divide(F.col("a"), F.col("b")).alias("d"), S.harmonic_mean(F.col("b"), F.col("b")).alias("h"), S.padded_index(F.col("n")).alias("p"), S.all_finite(F.col("v")).alias("f"), S.half_even(F.lit(2.5)).alias("e"), S.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("x"), S.clamp(F.lit(9), 0, 5).alias("c")
    ).first()
    assert (r.d, r.h, r.p, r.f, r.e, r.x, r.c) == (0, 0, "12345", False, 2, 64, 5)
    assert S.longest_common_subsequence("abcbdab", "bdcaba")[0] == 4


def test_quantile_bin_is_qcut(spark):
    for n in (6, 7, 23, 100):
        rows = spark.range(1, n + 1).select("id", *(ranking.quantile_bin(F.col("id"), F.lit(n), q).alias(f"q{q}") for q in (2, 5))).toPandas()
        for q in (2, 5):
            assert rows[f"q{q}"].tolist() == pd.qcut(rows["id"], q, labels=False).tolist()


def test_greedy_match(spark):
    c = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 0, 1, 0.95), ("a", 1, 1, 0.9), ("b", 0, 0, 0.5), ("b", 1, 0, 0.5)], "image string, i int, j int, iou double")
    got = sorted((r.image, r.i, r.j) for r in compare.greedy_match(c).collect())
    assert got == [("a", 0, 1), ("b", 0, 0)]


def test_statistics():
    assert abs(compare.ks_pvalue(0.5, 20, 20) - 0.008) < 0.01 and compare.ks_pvalue(0.0, 5, 5) == 1
    assert abs(compare.spearman_pvalue(0.5, 20) - 0.0248) < 0.001
    t = pd.DataFrame({"x": np.arange(50.0)})
    r = compare.bootstrap_exact(t, ["x"], 500).iloc[0]
    assert r.ci95_low < 24.5 < r.ci95_high


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([(i, float(i % 10) - 4) for i in range(400)], "k long, x double")
    a, b = (compare.bootstrap_means(df.repartition(n), "k", ["x"], 400).first() for n in (1, 3))
    assert abs(a.delta_mean - b.delta_mean) < 1e-9 and a.ci95_low < 0.5 < a.ci95_high


def test_group_kfold(spark):
    rows = [(i, f"g{i % 40}", f"s{(i % 40) % 3}") for i in range(400)]
    out = split.group_kfold(spark.createDataFrame(rows, "id long, grp string, s string"), "grp", "s", 5, blocks=1)
    assert validate.leakage(out, "fold", "grp").first().leaking == 0 and out.count() == 400
    per = out.groupBy("fold", "s").count().toPandas()
    assert per.groupby("s")["count"].agg(lambda x: x.max() - x.min()).max() <= 20
    train, val = split.fold_views(out, 0)
    assert train.count() + val.count() == 400


def test_strata_and_acceptance(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(20)], "id long, a double, b double")
    assert {r.stratum for r in split.stratum_bins(df, "a", "b", ["id"]).collect()} <= {f"w{i}_s{j}" for i in range(5) for j in range(2)}
    rule = lambda e, d, c, l, r: spark.range(1).select(split.accept_rule(F.lit(e), F.lit(d), F.lit(c), F.lit(l), F.lit(r)).alias("x")).first().x  # noqa: E731, E741
    assert rule(True, 60, 0.0, 1, 9) == "exact_sha256" and rule(False, 2, 0.0, 10, 10) == "phash_le2_words_le10pct" and rule(False, 6, 0.95, 10, 10) == "phash_le6_corr_ge090_words_le10pct" and rule(False, 6, 0.5, 10, 10) == ""


def test_contracts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, w double")
    assert validate.contract_join(a, b, ["k"]).count() == 2
    for left, right in ((a, b.limit(1)), (a.union(a), b)):
        with pytest.raises(validate.ContractError):
            validate.contract_join(left, right, ["k"])
    with pytest.raises(validate.ContractError):
        validate.expect_no_nulls(a.withColumn("v", F.lit(None).cast("string")), "v")
    with pytest.raises(validate.ContractError):
        validate.expect_columns(a, ["nope"])


def test_submission_checks(spark):
    csv = spark.createDataFrame([("a", "0 0 1 0 1 1 0 1"), ("b", ""), ("b", ""), ("c", "0 0 1 x 1 1 0 1|0 0 1 1"), ("e", "0 0 1 0 1 1 0 NaN")], "filename string, polygons string")
    expected = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 3)], "filename string, n long")
    r = validate.csv_checks(csv, expected).first()
    assert (r.rows, r.duplicate_rows, r.missing, r.extra, r.bad_sets, r.infinite_sets, r.count_mismatches) == (5, 1, 1, 1, 2, 1, 1)
    polys = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("a", [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]), ("b", [(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 30.0)]), ("b", [(0.0, float("nan")), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], f"image string, polygon {P.POLYGON}")
    r = validate.passed(validate.polygon_checks(polys, F.lit(20), F.lit(20))).first()
    assert (r.images, r.polygons, r.short_polygons, r.zero_area, r.bad_numbers, r.far_outside, r.passed) == (2, 4, 1, 1, 1, 1, False)


def test_json_round_trip(spark, tmp_path):
    doc = {"images": {"000001.jpg": {"words": {"0001": {"points": [[0.5, 1.5], [10, 0], [10, 5], [0, 5]], "orientation": "h", "language": "en"}, "0002": {"points": []}}, "img_w": 20, "img_h": 10}, "000002.jpg": {"img_w": 5, "img_h": 5}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    docs = annotations.read_documents(spark, str(tmp_path / "a.json"))
    words = annotations.words(docs).collect()
    assert len(words) == 1 and words[0].word == "0001" and (words[0].polygon[0].x, words[0].polygon[0].y) == (0, 2)
    assert {r.filename: r.words for r in annotations.word_counts(docs).collect()} == {"000001.jpg": 2, "000002.jpg": 0}
    out = sinks.prediction_json(annotations.words(docs), "filename", "word").first()
    assert json.loads(out.json)["words"]["0001"]["points"][2] == [10, 5]
    with pytest.raises(validate.ContractError):
        annotations.tagged(train=docs, val=docs)


def test_files_and_lines(spark, tmp_path):
    for n in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = annotations.list_images(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.JPG", "b.png"]
    assert annotations.present(spark.createDataFrame([("a.JPG",), ("z",)], "filename string"), files).count() == 1
    sinks.write_csv(spark.createDataFrame([("a", "1 2|3 4")], "filename string, polygons string"), str(tmp_path / "out"))
    back = annotations.read_submission(spark, str(tmp_path / "out")).select(annotations.decode_polygons(F.col("polygons")).alias("p")).first()
    assert back.p == [[1.0, 2.0], [3.0, 4.0]]
    df = spark.createDataFrame([("1, 2,3,4,hello, you",), ("1,2,3",)], "line string")
    r = [x.p for x in df.select(annotations.parse_ltrb(F.col("line"), True).alias("p")).collect()]
    assert list(r[0]["values"]) == [1, 2, 3, 4] and r[0]["transcription"] == "hello, you" and r[1] is None
    q = spark.createDataFrame([("1,2,3,4,5,6,7,8,0.5,",)], "line string").select(annotations.parse_quad(F.col("line"), confidence=True).alias("p")).first().p
    assert list(q["values"]) == list(range(1, 9)) and q["confidence"] == 0.5
    assert [r[0] for r in spark.createDataFrame([("x000123.jpg",), ("no",)], "f string").select(annotations.numeric_id(F.col("f"))).collect()] == [123, None]
    assert "| 0.5000 |" in sinks.markdown(spark.createDataFrame([(0.5,)], "x double"))


def test_probability_maps(spark):
    v = np.zeros((40, 60))
    v[10:20, 10:40] = 0.9
    v[30:32, 50:52] = 0.9
    df = spark.createDataFrame([("a", 40, 60, v.ravel().tolist())], "image string, height int, width int, values array<float>")
    r = probability_maps.detect(df).collect()
    assert len(r) == 1 and r[0].score > 0.8
    flat = np.array(r[0].flat).reshape(4, 2)
    assert flat[:, 0].min() < 10 and flat[:, 0].max() > 39
    mixed = df.select(probability_maps.ensemble(F.col("values"), F.col("values"), 0.75).alias("m")).first().m
    assert np.allclose(mixed, v.ravel(), atol=1e-6)
    fused = probability_maps.fuse_scales([v, probability_maps.resize(v, 20, 30)], [np.ones((40, 60)), np.ones((20, 30))])
    assert np.abs(fused - v).mean() < 0.05
    stats = probability_maps.prediction_statistics(spark.createDataFrame([(0.5, 10.0), (0.7, 20.0)], "score double, area double")).first()
    assert (stats.boxes, stats.area_median) == (2, 15)


def test_polygon_features(spark):
    words = spark.createDataFrame([("a", [(0.0, 0.0), (100.0, 0.0), (100.0, 10.0), (0.0, 10.0)], 1024, 512)], f"filename string, polygon {P.POLYGON}, width int, height int")
    r = P.polygon_features(words).first()
    assert (r.gt_regions, r.short_side_1024_median, r.small_text_lt12_ratio, r.small_text_lt8_ratio) == (1, 10, 1, 0)


def test_streaming_scores(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:00:00", 4, 4, 3, 1, 0, 1.0, 0.0, 1, 0) for h in (0, 0, 1, 3)]
    names = ", ".join(f"{c} {'double' if 'gran' in c else 'long'}" for c in cleval.COUNTERS)
    df = spark.createDataFrame(rows, f"t string, {names}").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_scores(stream, "t").writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    got = {r.window.start.hour: r.tp for r in spark.table("scores").collect()}
    assert got == {0: 6, 1: 3, 3: 3}


def test_ranks_are_distributed_and_exact(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(500)], "id long, v double")
    got = {r.id: r.rank for r in ranking.global_rank(df, ["v", "id"]).collect()}
    order = sorted(range(500), key=lambda i: (i * 37 % 101, i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    s = compare.spearman(df.withColumn("w", -F.col("v")), "v", "w").first()
    assert abs(s.rho + 1) < 1e-9


def test_weighted_sample(spark):
    df = spark.createDataFrame([(i, "big" if i < 900 else "small") for i in range(1000)], "id long, family string")
    got = split.weighted_sample(df, "family", 2000, key="id").groupBy("family").count().toPandas()
    assert got["count"].sum() == 2000 and got["count"].min() > 850


def test_images(spark):
    from plumbline.operators import images, selection

    flat = np.full((20, 20, 3), 230, np.uint8)
    step = np.zeros((20, 20, 1), np.uint8)
    step[:, 10:] = 255
    rows = [("flat", 20, 20, flat.tobytes()), ("step", 20, 20, step.tobytes()), ("bad", 20, 20, b"xyz"), ("none", 20, 20, None)]
    out = images.describe(spark.createDataFrame(rows, "filename string, height int, width int, pixels binary"))
    good, bad = images.split_errors(out)
    got = {r.filename: r for r in good.collect()}
    assert sorted(r.filename for r in bad.collect()) == ["bad", "none"] and set(got) == {"flat", "step"}
    assert (got["flat"].bright_fraction, got["flat"].entropy, got["flat"].edge_density, got["flat"].saturation) == (1, 0, 0, 0)
    assert got["step"].entropy == 1 and got["step"].dark_fraction == 0.5 and 0 < got["step"].edge_density < 0.2
    x = np.random.default_rng(0).uniform(0, 255, (64, 64))
    assert S.hamming and images.perceptual_hash(x) == images.perceptual_hash(x * 0.5 + 10)
    with pytest.raises(Exception, match="family"):
        selection.tag_family(spark.createDataFrame([("a",)], "source string"), {"b": "c"}).collect()
    assert selection.with_prefix(spark.createDataFrame([(1, 2, 3)], "k int, a_x int, b_x int"), "a_", "k").columns == ["k", "a_x"]


def test_scale_wise(spark):
    gt = spark.createDataFrame([("a", 0, *box(0, 40), False), ("a", 1, *box(50, 130, 0, 60), False)], GT)
    det = spark.createDataFrame([("a", 0, *box(0, 40)), ("a", 1, *box(200, 240))], DET)
    out = {r.bin: r for r in cleval.scale_wise(gt, det, spark.createDataFrame([("a", 200.0)], "image string, longest double"), [(0.0, 0.1), (0.1, 1.0)]).collect()}
    assert (out[0].recall, out[0].tp, out[1].recall) == (1, 4, 0) and out[0].fp == out[1].fp > 0


def test_numbers_and_quantiles_in_groups(spark):
    """Ranges inside groups against pandas: a hot group, ties, nulls in values and groups, single rows, over 64 ranges."""
    from unittest import mock

    rng = np.random.default_rng(4)
    rows = [(str(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 6000) ** 2, rng.integers(0, 2000, 6000), strict=True))]
    rows += [(None, 1.0, -1), (None, 4.0, -2), ("one", 7.0, -3), ("none", None, -4), ("0", None, -5)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    for least in (1 << 20, 20):  # 64 ranges, some 300
        with mock.patch.object(ranking, "ROWS_OF_RANGE", least):
            got = {r.id: (r.k, r.n) for r in ranking.numbered(df, ["g"], ["v", "id"], "k", "n").collect()}
            quantiles = {r.g: r.q for r in ranking.quantiles(df, ["g"], "v", [0.1, 0.5, 1.0], "q").collect()}
            totals = {(r.g, r.v): r["__total_id"] for r in ranking.running_total(df.where("id >= 0"), "v", ["id"], ["g"]).groupBy("g", "v").agg(F.max("__total_id").alias("__total_id")).collect()}
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [got[r[2]] for r in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
            values = [r[1] for r in own if r[1] is not None]
            if values:
                assert np.allclose(quantiles[g], np.quantile(values, [0.1, 0.5, 1.0]))
            else:
                assert g not in quantiles
            for v in {r[1] for r in own if r[2] >= 0 and r[1] is not None}:
                assert totals[g, v] == sum(r[2] for r in own if r[2] >= 0 and r[1] <= v)
