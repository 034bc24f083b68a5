"""More registered queries: readers, filters, polygons, images, maps and validators on broken rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygons as P
from ..functions import scalar as S
from ..operators import cleval, compare, images, probability_maps, ranking, selection, split, validate
from ..sources import annotations, sinks
from . import boxes as B
from .boxes import table
from .catalog import _round, query

# Readers and writers

_WORDS = "SELECT image::VARCHAR || '.jpg' AS filename, printf('%04d', k) AS word, 4::INT AS points, round_even(25 * k + l_quantity / 2, 0) AS x, round_even(l_quantity / 2, 0) AS y, 640::INT AS width, (100 + image % 7)::INT AS height FROM li"


def _documents(spark, sf_dir):
    """Annotation documents as JSON text, one an image, with an empty word and an image without words among them."""
    rows = B.lines(spark, sf_dir)
    x, y = 25 * F.col("k") + F.col("l_quantity") / 2, F.col("l_quantity") / 2
    p = G.box_polygon(x, y, x + 10, y + 5)
    words = sinks.prediction_json(rows.select("image", "k", p.alias("polygon")))
    with_empty = F.regexp_replace("json", r"\}\}$", ',"9999":{"points":[]}}')
    name = F.concat(F.col("filename").cast("string"), F.lit(".jpg"))
    each = words.select(F.concat(F.lit('{"images":{"'), name, F.lit('":'), with_empty, F.lit(',"img_w":640,"img_h":'), (100 + F.col("filename") % 7).cast("string"), F.lit('},"none.jpg":{"img_w":1,"img_h":1}}}')).alias("value"))
    return each.select(F.explode(F.from_json("value", annotations.DOCUMENT).images).alias("filename", "image"))


@query(f"WITH {B.LINES} {_WORDS}")
def annotation_words(spark, sf_dir):
    w = annotations.words(_documents(spark, sf_dir))
    return w.select("filename", "word", F.size("polygon").alias("points"), F.col("polygon")[0]["x"].alias("x"), F.col("polygon")[0]["y"].alias("y"), "width", "height")


@query(f"WITH {B.LINES}, w AS (SELECT image, count(*)::INT + 1 AS n FROM li GROUP BY image) SELECT 'none.jpg' AS filename, 0::INT AS words, count(*) AS documents FROM w UNION ALL SELECT image::VARCHAR || '.jpg', n, 1 FROM w")
def annotation_counts(spark, sf_dir):
    return annotations.word_counts(_documents(spark, sf_dir)).groupBy("filename", "words").agg(F.count("*").alias("documents"))


@query(f"WITH {B.LINES} SELECT image, k, k % 5 <> 0 AS fits, CASE WHEN k % 5 <> 0 THEN 25 * k + 25 * k + l_quantity::INT + 10 ELSE -1 END AS total, CASE WHEN k % 5 <> 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN k % 5 <> 0 THEN 'a,b ' || k END AS transcription FROM li")
def parsed_lines(spark, sf_dir):
    x0 = (25 * F.col("k")).cast("string")
    x1 = (25 * F.col("k") + F.col("l_quantity").cast("int")).cast("string")
    line = F.concat_ws(",", x0, F.when(F.col("k") % 5 == 0, "x").otherwise(" 0"), x1, F.lit("10 "), F.lit("0.5"), F.concat(F.lit("a,b "), F.col("k").cast("string")))
    got = B.lines(spark, sf_dir).select("image", "k", annotations.parse_ltrb(line, transcription=True, confidence=True).alias("p"))
    return got.select("image", "k", F.col("p").isNotNull().alias("fits"), F.aggregate(F.transform("p.values", lambda v: v.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), "p.confidence", "p.transcription").fillna({"total": -1})


@query(f"WITH {B.LINES} SELECT image, k, 2 * (25 * k + 25 * k + l_quantity::INT) + 20 AS total FROM li")
def parsed_quads(spark, sf_dir):
    x0, x1 = 25 * F.col("k"), 25 * F.col("k") + F.col("l_quantity").cast("int")
    line = F.concat(F.array_join(F.transform(F.array(x0, F.lit(0), x1, F.lit(0), x1, F.lit(10), x0, F.lit(10)), lambda v: v.cast("string")), ", "), F.lit(","))
    got = B.lines(spark, sf_dir).select("image", "k", annotations.parse_quad(line).alias("p"))
    return got.select("image", "k", F.aggregate(F.transform("p.values", lambda v: v.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("SELECT unnest([" + ", ".join(f"'{t}.parquet'" for t in _TABLES) + "]) AS filename, 'tables' AS source")
def file_listing(spark, sf_dir):
    return annotations.list_images(spark, sf_dir, extensions=("parquet",), source="tables").select("filename", "source")


@query("SELECT unnest(['orders.parquet', 'part.parquet']) AS filename")
def files_present(spark, sf_dir):
    named = spark.createDataFrame([("orders.parquet",), ("lost.jpg",), ("part.parquet",)], "filename string")
    return annotations.present(named, annotations.list_images(spark, sf_dir, extensions=("parquet",)))


_JSON = "SELECT image AS filename, '{\"words\":{' || string_agg('\"' || printf('%04d', k) || '\":{\"points\":[[' || (25 * k)::VARCHAR || '.0,0.0],[' || (25 * k + l_quantity::INT)::VARCHAR || '.0,10.0]]}', ',' ORDER BY k) || '}}' AS json FROM li GROUP BY image"


@query(f"WITH {B.LINES} {_JSON}")
def prediction_json_text(spark, sf_dir):
    p = F.array(G.point(25 * F.col("k"), F.lit(0)), G.point(25 * F.col("k") + F.col("l_quantity").cast("int"), F.lit(10)))
    return sinks.prediction_json(B.lines(spark, sf_dir).select("image", "k", p.alias("polygon")))


# Filters, joins, names


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders")
def prefix_columns(spark, sf_dir):
    return selection.with_prefix(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"), "o_order", "o_orderkey")


@query("SELECT o_orderkey, 'split_w' || (o_custkey % 5) || '_s' || (o_orderkey % 3) AS stratum, 'images/' || printf('%06d', o_orderkey) || '.jpg' AS path, o_orderkey::INT AS number, NULL::INT AS none FROM orders")
def derived_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("split_w%d_s%d", F.col("o_custkey") % 5, F.col("o_orderkey") % 3).alias("stratum"), F.format_string("images/%06d.jpg", "o_orderkey").alias("path"))
    return o.withColumn("number", annotations.numeric_id(F.col("path"))).withColumn("none", annotations.numeric_id(F.regexp_replace("path", "jpg", "png")))


@query(f"WITH {B.LINES} SELECT image, k FROM li WHERE (4 + k % 7) >= 8 AND (4 + k % 7) % 2 = 0")
def admitted_polygons(spark, sf_dir):
    flat = F.transform(F.sequence(F.lit(1), (4 + F.col("k") % 7).cast("int")), lambda v: v.cast("double"))
    return B.lines(spark, sf_dir).select("image", "k", flat.alias("flat")).where(cleval.admitted(F.col("flat"))).select("image", "k")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice AS first_score, o_totalprice + o_custkey AS second_score, o_totalprice + o_custkey - o_totalprice AS score_delta FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def three_way_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("score"))
    second = o.where("o_orderkey % 5 <> 0").select("o_orderkey", (F.col("o_totalprice") + F.col("o_custkey")).alias("score"))
    return compare.three_way(o.select("o_orderkey", "o_orderstatus"), first, second, "o_orderkey", "score")


@query("SELECT o_orderkey, o_totalprice AS control, o_custkey AS candidate FROM orders")
def exact_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return validate.contract_join(o.select("o_orderkey", F.col("o_totalprice").alias("control")), o.select("o_orderkey", F.col("o_custkey").alias("candidate")), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice / greatest(o_custkey - 700, 1) AS guarded, greatest(0, least(o_totalprice, 99999)) AS clamped, o_totalprice / greatest(0 * o_custkey, 1e-12::DOUBLE) AS tiny FROM orders")
def guarded_ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.col("o_totalprice")
    return o.select("o_orderkey", S.guarded_ratio(v, F.col("o_custkey") - 700, 1.0).alias("guarded"), S.clamp(v, 0.0, 99999.0).alias("clamped"), S.guarded_ratio(v, 0 * F.col("o_custkey")).alias("tiny"))


@query("WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '###' WHEN 1 THEN NULL ELSE 'word' END AS t, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS f FROM documents) SELECT doc_id, coalesce(f, t = '###', false) AS dc, coalesce(t, repeat('#', (doc_id % 6)::INT)) AS marks FROM t")
def dont_care_texts(spark, sf_dir):
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, "###").when(i % 4 != 1, "word")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("transcription"), F.when(i % 3 == 0, i % 2 == 0).alias("dc"))
    return cleval.prepared(rows).select("doc_id", "dc", cleval.transcription_or_marks(F.col("transcription"), (i % 6).cast("int")).alias("marks"))


# Polygons

_BOX = "SELECT image, k, 25.0::DOUBLE * k AS x0, 25.0::DOUBLE * k + l_quantity AS x1, l_quantity AS w FROM li"


def _boxes(spark, sf_dir):
    x0, w = 25.0 * F.col("k"), F.col("l_quantity")
    return B.lines(spark, sf_dir).select("image", "k", "l_tax", "l_discount", x0.alias("x0"), (x0 + w).alias("x1"), w.alias("w"))


@query(f"WITH {B.LINES}, b AS ({_BOX}), c AS (SELECT *, unnest(range(0, 4)) AS c FROM b) SELECT image, k, least(100, (w + w) / (20 + {B.EPS})) AS aspect, round(sum(x0 + w * ((c + 0.5) / 4)), 6) AS x_sum, 20.0::DOUBLE AS y_sum FROM c GROUP BY image, k, w")
def quad_features(spark, sf_dir):
    q = G.box_polygon(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(10.0))
    rows = _boxes(spark, sf_dir).select("image", "k", q.alias("q"))
    centres = G.quad_centres(F.col("q"), F.lit(4), F.lit(False))
    total = lambda a: F.aggregate(F.transform("c", lambda p: p[a]), F.lit(0.0), lambda s, v: s + v)
    return rows.select("image", "k", G.quad_aspect_ratio(F.col("q")).alias("aspect"), centres.alias("c")).select("image", "k", "aspect", F.round(total("x"), 6).alias("x_sum"), total("y").alias("y_sum"))


@query(f"WITH {B.LINES}, b AS ({_BOX}) SELECT image, k, w * 5 AS inside, 0.0::DOUBLE AS apart, round(greatest(0, w - 3) * 10, 6) AS shifted FROM b")
def polygon_intersections(spark, sf_dir):
    box = lambda dx, y1: G.box_polygon(F.col("x0") + dx, F.lit(0.0), F.col("x1") + dx, F.lit(y1))
    half = F.array(G.point(F.col("x0"), F.lit(0)), G.point(F.col("x1"), F.lit(0)), G.point(F.col("x0"), F.lit(10)))  # a triangle: half of the box
    pair = lambda a, b, name: F.round(P.intersection_of(a, b), 6).alias(name)
    return _boxes(spark, sf_dir).select("image", "k", pair(half, box(0.0, 10.0), "inside"), pair(box(0.0, 10.0), box(200.0, 10.0), "apart"), pair(box(0.0, 10.0), box(3.0, 10.0), "shifted"))


@query(f"WITH {B.LINES}, b AS ({_BOX}) SELECT image, k, round(least(w, 10), 6) AS short, round(greatest(w, 10), 6) AS long, round(w * sqrt(2), 6) AS diamond, round(least(100, 10 / (w + {B.EPS})), 6) AS aspect FROM b")
def min_area_rectangles(spark, sf_dir):
    x, w = F.col("x0"), F.col("w")
    box = G.box_polygon(x, F.lit(0.0), F.col("x1"), F.lit(10.0))
    diamond = F.array(G.point(x - w, 0), G.point(x, w), G.point(x + w, 0), G.point(x, -w))
    rows = _boxes(spark, sf_dir).select("image", "k", P.polygon_rectangle(box).alias("r"), P.polygon_rectangle(diamond).alias("d"), P.polygon_aspect_ratio(box).alias("a"))
    return rows.select("image", "k", *(F.round(c, 6).alias(n) for c, n in (("r.short", "short"), ("r.long", "long"), ("d.short", "diamond"), ("a", "aspect"))))


@query(f"WITH {B.LINES}, b AS ({_BOX}) SELECT image, k, round((w + 2 * d) * (10 + 2 * d), 6) AS grown, round(x0 - d, 6) AS left FROM (SELECT *, w * 10 * 1.5 / (2 * (w + 10)) AS d FROM b)")
def grown_polygons(spark, sf_dir):
    box = G.box_polygon(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(10.0))
    rows = _boxes(spark, sf_dir).select("image", "k", P.polygon_offset(box, 1.5).alias("p"))
    return rows.select("image", "k", F.round(G.area(F.col("p")), 6).alias("grown"), F.round(G.bounds(F.col("p"))["x0"], 6).alias("left"))


@query(
    f"WITH {B.LINES}, b AS ({_BOX}), r AS (SELECT image, least(w, 10) * 1024 / 640 AS short, w * 10 / (640 * 500) AS ratio FROM b) SELECT image AS filename, count(*) AS gt_regions, 4.0::DOUBLE AS vertices_mean, 4::INT AS vertices_max, round(median(short), 9) AS short_side_1024_median, round(quantile_cont(short, 0.1), 9) AS short_side_1024_q10, "
    "round(avg((short < 8)::INT), 9) AS small_text_lt8_ratio, round(avg((short < 12)::INT), 9) AS small_text_lt12_ratio, round(median(ratio), 9) AS polygon_area_ratio_median, round(sum(ratio), 9) AS polygon_area_ratio_sum FROM r GROUP BY image"
)
def polygon_audit(spark, sf_dir):
    box = G.box_polygon(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(10.0))
    rows = _boxes(spark, sf_dir).select(F.col("image").alias("filename"), box.alias("polygon"), F.lit(640).alias("width"), F.lit(500).alias("height"))
    dropped = rows.where("filename % 9 = 0").withColumn("polygon", F.slice("polygon", 1, 2))  # lines: no polygons
    out = P.polygon_features(rows.unionByName(dropped)).drop("polygon_angle_abs_median")
    return _round(out, *(c for c in out.columns if c not in ("filename", "gt_regions", "vertices_max")), digits=9)


@query(f"WITH {B.sides()}, {B.related()}, {B.counted()} SELECT image, n_gt, n_det, tp, fp, overlapped, n_split, n_merged, round(hmean, 6) AS hmean FROM per")
def cleval_polygons(spark, sf_dir):
    """The boxes of cleval_per_image as general polygons."""
    rows = B.lines(spark, sf_dir)
    shape = G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon")
    per = P.evaluate_polygons(B.ground_truth(rows).select("image", "g", "dc", shape), B.detections(rows).select("image", "d", shape))
    return _round(per.select("image", "n_gt", "n_det", "tp", "fp", "overlapped", "n_split", "n_merged", "hmean"), "hmean")


# Images and maps

_PIXELS = "px AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: greatest(0, least(255, trunc(128 + 256 * x::DOUBLE)))::INT)) AS v FROM embeddings WHERE vec_id % 50 <> 0)"


@query(
    f"WITH {_PIXELS}, s AS (SELECT vec_id, avg(v) / 255 AS b, stddev_pop(v) / 255 AS c, avg((v < 64)::INT) AS d, avg((v > 224)::INT) AS h FROM px GROUP BY vec_id), n AS (SELECT vec_id, v, count(*) / 64 AS p FROM px GROUP BY ALL), e AS (SELECT vec_id, sum(-p * log2(p)) AS e FROM n GROUP BY vec_id) "
    "SELECT vec_id, false AS read_error, round(b, 6) AS brightness, round(c, 6) AS contrast, round(e, 6) AS entropy, 0.0::DOUBLE AS saturation, d AS dark_fraction, h AS bright_fraction FROM s JOIN e USING (vec_id) UNION ALL SELECT vec_id, true, NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE vec_id % 50 = 0"
)
def image_quality(spark, sf_dir):
    """Vectors as 8 x 8 gray images, some of them cut short."""
    pixels = F.aggregate("embedding", F.lit(""), lambda s, x: F.concat(s, F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), (128 + 256 * x.cast("double")).cast("int")))), 2, "0")))
    whole = F.unhex(pixels)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(F.col("vec_id") % 50 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("pixels"))
    good, bad = images.split_errors(images.describe(rows, "vec_id"))
    names = ("brightness", "contrast", "entropy", "saturation", "dark_fraction", "bright_fraction")
    return _round(good.unionByName(bad).select("vec_id", "read_error", *names), "brightness", "contrast", "entropy")


_RECT = "r AS (SELECT c_custkey AS image, 8 + c_custkey % 5 AS x0, 10 + c_custkey % 3 AS y0, 3 * (4 + c_custkey % 4) AS w, 4 + c_custkey % 4 AS h FROM customer)"


@query(
    f"WITH {_RECT}, g AS (SELECT *, w * h * 1.5 / (2 * (w + h)) AS d FROM r) SELECT image, 1::INT AS k, round(0.9::FLOAT::DOUBLE, 5) AS score, round_even(x0 - d, 0) AS x0, round_even(y0 - d, 0) AS y0, round_even(x0 + w + d, 0) AS x1, round_even(y0 + h + d, 0) AS y1 FROM g"
)
def map_rectangles(spark, sf_dir):
    """A bright rectangle in each map, and a speck that is too small."""
    i = F.col("c_custkey")
    x0, y0, h = 8 + i % 5, 10 + i % 3, 4 + i % 4
    dark, bright = F.lit(0.1).cast("float"), F.lit(0.9).cast("float")
    empty, speck = B.stretch((dark, 48)), B.stretch((dark, 1), (bright, 1), (dark, 46))
    held = B.stretch((dark, x0), (bright, 3 * h + 1), (dark, 47 - x0 - 3 * h))
    values = F.flatten(B.stretch((empty, 1), (speck, 1), (empty, y0 - 2), (held, h + 1), (empty, 39 - y0 - h)))
    maps = B.dealt(table(spark, sf_dir, "customer"), "c_custkey").select(i.alias("image"), F.lit(40).alias("height"), F.lit(48).alias("width"), values.alias("values"))
    got = probability_maps.detect(maps, probability_maps.Settings(threshold=0.5, box_threshold=0.6))
    f = F.col("flat")
    return got.select("image", F.lit(1).alias("k"), F.round("score", 5).alias("score"), f[0].alias("x0"), f[1].alias("y0"), f[4].alias("x1"), f[5].alias("y1"))


@query(
    "WITH v AS (SELECT a.vec_id AS image, unnest(list_zip(a.embedding, b.embedding, range(64))) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)), f AS (SELECT image, z[1]::DOUBLE AS x, z[2]::DOUBLE AS y, (z[3] % 3 <> 0)::INT AS m, (z[3] % 4 <> 0)::INT * 0.5 AS n FROM v) "
    "SELECT image, 8::INT AS height, 8::INT AS width, round(sum(CASE WHEN m + n > 0 THEN (x * m + y * n) / (m + n) ELSE 0 END), 6) AS total FROM f GROUP BY image"
)
def fused_scales(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    mask = lambda every, weight: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % every != 0, weight).otherwise(0.0))
    first = e.select(F.col("vec_id").alias("image"), F.lit(1).alias("k"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"), mask(3, 1.0).alias("mask"))
    second = e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("image"), F.lit(2).alias("k"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"), mask(4, 0.5).alias("mask"))
    fused = probability_maps.fuse(first.unionByName(second))
    return fused.select("image", "height", "width", F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


# Splits


@query("WITH p AS (SELECT o_orderkey AS id, o_custkey % 11 AS d, (o_orderkey % 100) / 100 AS c, 100 + o_custkey % 30 AS a, 100 + o_orderkey % 30 AS b, o_orderkey % 50 = 0 AS e FROM orders), q AS (SELECT *, abs(a - b) / greatest(a, b, 1e-12) <= 0.1 AS near FROM p) SELECT id, CASE WHEN e THEN 'exact_sha256' WHEN d <= 2 AND near THEN 'phash_le2_words_le10pct' WHEN d <= 6 AND c >= 0.9 AND near THEN 'phash_le6_corr_ge090_words_le10pct' ELSE '' END AS rule FROM q")
def near_dup_rules(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), split.accept_rule(k % 50 == 0, c % 11, (k % 100) / 100, 100 + c % 30, 100 + k % 30).alias("rule"))


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 5)::INT END AS fold FROM documents WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, 4 FROM documents WHERE doc_id % 35 = 1), p AS (SELECT * FROM d WHERE fold IS NOT NULL), "
    "k AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(DISTINCT fold) > 1), s AS (SELECT fold, count(DISTINCT doc_id) AS shared FROM p WHERE doc_id IN (SELECT doc_id FROM k) GROUP BY fold), u AS (SELECT count(*) AS uncovered FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) "
    "SELECT fold, (SELECT count(*) FROM p) - count(*) AS training, count(*) AS validation, coalesce(any_value(shared), 0) AS shared, any_value(uncovered) AS uncovered, coalesce(any_value(shared), 0) = 0 AS disjoint, any_value(uncovered) = 0 AS exhaustive FROM p LEFT JOIN s USING (fold), u GROUP BY fold"
)
def fold_preparation(spark, sf_dir):
    """A broken assignment: documents without a row, without a fold, and in two folds."""
    docs, i = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    rows = docs.where(i % 13 != 0).select("doc_id", F.when(i % 11 != 0, (i % 5).cast("int")).alias("fold"))
    twice = docs.where(i % 35 == 1).select("doc_id", F.lit(4).alias("fold"))
    return split.fold_checks(rows.unionByName(twice), "doc_id", manifest=docs)


@query("WITH d AS (SELECT doc_id, source || '/' || (doc_id % 16) AS g FROM documents), g AS (SELECT g, count(*) AS n FROM d GROUP BY g) SELECT (SELECT count(*) FROM d) AS rows, (SELECT count(*) FROM g) AS groups, 5::BIGINT AS folds, 0::BIGINT AS leaking, true AS even")
def group_kfold_checks(spark, sf_dir):
    """Folds of whole groups: all rows, none leaking, sizes within the largest group."""
    from .catalog import queries

    rows = queries()["group_kfold"](spark, sf_dir)
    per = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("f"))
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n")).agg(F.count("*").alias("folds"), (F.max("n") - F.min("n")).alias("d"))
    facts = per.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("f") > 1).alias("leaking"), F.max("n").alias("most"))
    return facts.join(sizes).select("rows", "groups", "folds", "leaking", (F.col("d") <= 2 * F.col("most")).alias("even"))


@query("SELECT (SELECT count(*) FROM documents) AS draws, (SELECT count(DISTINCT source) FROM documents) AS families, true AS even, 0::BIGINT AS strangers")
def family_sample_checks(spark, sf_dir):
    """As many draws as rows, all families, each about equally often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    drawn = split.weighted_sample(docs, "source", docs.count(), key="doc_id")
    sizes = drawn.groupBy("source").agg(F.count("*").alias("n")).agg(F.sum("n").alias("draws"), F.count("*").alias("families"), F.max("n").alias("most"), F.min("n").alias("least"))
    strangers = drawn.select("doc_id", "source").join(docs, ["doc_id", "source"], "left_anti").agg(F.count("*").alias("strangers"))
    return sizes.join(strangers).select("draws", "families", (F.col("most") - F.col("least") <= 6 * F.sqrt(F.col("draws") / F.col("families")) + 1).alias("even"), "strangers")


# Validators on broken rows, strata, global bootstrap


@query(
    f"WITH {B.LINES}, p AS (SELECT image, k FROM li WHERE image % 10 <> 3) SELECT (SELECT count(DISTINCT image) FROM p) AS rows, (SELECT count(DISTINCT image) FROM li WHERE image % 10 = 3) + 1 AS missing_images, (SELECT count(DISTINCT image) FROM p WHERE image % 10 = 4) AS extra_images, (SELECT count(DISTINCT image) FROM p WHERE image % 10 = 5) AS empty_images, "
    "0::BIGINT AS least_polygons, (SELECT max(n) FROM (SELECT count(*) AS n FROM p WHERE image % 10 <> 5 GROUP BY image)) AS most_polygons, (SELECT round(sum((image % 10 <> 5)::INT) / count(DISTINCT image), 6) FROM p) AS mean_polygons, (SELECT count(*) FROM p WHERE image % 10 <> 5) AS polygons, (SELECT count(*) FROM p WHERE image % 10 = 6) AS short_polygons, "
    "(SELECT count(*) FROM p WHERE image % 10 = 7) AS bad_numbers, (SELECT count(*) FROM p WHERE image % 10 = 8) AS zero_area, (SELECT count(*) FROM p WHERE image % 10 = 9) AS invalid_geometry, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p WHERE image % 10 = 0 GROUP BY image)) AS duplicate_polygons, "
    "(SELECT count(*) FROM p WHERE image % 10 = 1) AS outside, (SELECT count(*) FROM p WHERE image % 10 = 1) AS far_outside, 0::BIGINT AS full_images, false AS passed"
)
def broken_submission(spark, sf_dir):
    """A submission with every fault that the validator counts."""
    x = 25.0 * F.col("k")
    box = lambda a, b, c, d: F.array(G.point(a, b), G.point(c, b), G.point(c, d), G.point(a, d))
    kind = F.col("image") % 10
    fine = box(x, F.lit(1.0), x + 9, F.lit(10.0))
    polygon = (
        F.when(kind == 5, None)
        .when(kind == 6, F.slice(fine, 1, 3))
        .when(kind == 7, box(x, F.lit(float("nan")), x + 9, F.lit(10.0)))
        .when(kind == 8, box(x, F.lit(4.0), x + 9, F.lit(4.0)))
        .when(kind == 9, F.array(G.point(x, 1), G.point(x + 9, 9), G.point(x + 9, 1), G.point(x, 7)))
        .when(kind == 0, box(F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(9.0)))
        .when(kind == 1, box(x, F.lit(-20.0), x + 9, F.lit(10.0)))
        .otherwise(fine)
    )
    rows = B.lines(spark, sf_dir).select("image", "k")
    sent = rows.where(kind != 3).select("image", polygon.alias("polygon"))
    expected = rows.where(kind != 4).select("image").union(spark.createDataFrame([(-1,)], "image long"))
    return _round(validate.submission_report(sent, expected, F.lit(100_000), F.lit(100)), "mean_polygons")


_BROKEN_CSV = "SELECT o_orderkey AS i, o_orderkey % 7 AS c FROM orders"


@query(f"WITH s AS ({_BROKEN_CSV}) SELECT (SELECT count(*) FROM s WHERE c <> 0) + 1 + (SELECT count(*) FROM s WHERE c = 5 AND i % 3 = 0) AS rows, (SELECT count(*) FROM s WHERE c = 5 AND i % 3 = 0) AS duplicate_rows, (SELECT count(*) FROM s WHERE c = 0) AS missing, 1::BIGINT AS extra, (SELECT count(*) FROM s WHERE c IN (1, 2)) AS bad_sets, (SELECT count(*) FROM s WHERE c = 3) AS infinite_sets, (SELECT count(*) FROM s WHERE c = 4) AS count_mismatches")
def broken_csv(spark, sf_dir):
    c = F.col("i") % 7
    good = F.lit("0 0 9 0 9 9 0 9")
    text = F.when(c == 1, "0 0 x 0 9 9 0 9").when(c == 2, "0 0 9 0 9 9 0").when(c == 3, "0 0 Infinity 0 9 9 0 9").when(c == 4, "").otherwise(good)
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    name = F.col("i").cast("string").alias("filename")
    sent = keys.where(c != 0).select(name, text.alias("polygons"))
    extra = spark.createDataFrame([("nobody", "0 0 9 0 9 9 0 9")], "filename string, polygons string")
    expected = keys.select(name, F.lit(1).cast("long").alias("n"))
    twice = keys.where((c == 5) & (F.col("i") % 3 == 0)).select(name, good.alias("polygons"))
    return validate.csv_checks(sent.union(extra).union(twice), expected)


@query(
    "WITH d AS (SELECT doc_id, (doc_id % 5)::INT AS fold, source, n_chars::DOUBLE AS n FROM documents), f AS (SELECT fold, count(*) AS c, avg(n) AS m, sum((doc_id % 4 = 0)::INT) AS s FROM d GROUP BY fold), sh AS (SELECT abs(c / sum(c) OVER (PARTITION BY fold) - sum(c) OVER (PARTITION BY lang) / sum(c) OVER ()) AS x FROM (SELECT (doc_id % 5) AS fold, lang, count(*) AS c FROM documents GROUP BY ALL)) "
    "SELECT true AS expected_rows, (SELECT count(*) = count(DISTINCT doc_id) FROM d) AS unique_keys, (SELECT count(*) = 5 FROM f) AS all_folds, (SELECT max(c) - min(c) <= 2 FROM f) AS sizes_even, (SELECT max(k) = 1 FROM (SELECT count(DISTINCT fold) AS k FROM d GROUP BY source)) AS no_group_leakage, false AS no_pair_leakage, (SELECT max(s) - min(s) <= 2 FROM f) AS source_even, "
    "(SELECT max(abs(m - (SELECT avg(n) FROM d)) / (SELECT stddev_pop(n) FROM d)) < 0.15 FROM f) AS means_close, (SELECT max(x) < 0.01 FROM sh) AS shares_close, false AS passed"
)
def split_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    pairs = d.select(F.col("doc_id").alias("left"), (F.col("doc_id") + 1).alias("right"))
    return selection.split_report(d, "doc_id", "fold", "source", "lang", F.col("doc_id") % 4 == 0, ["n_chars"], pairs, d.count(), 5)


_PAIRS = "p AS (SELECT o_orderkey AS image, o_totalprice / 1000 AS a, o_totalprice / 1000 + (o_orderkey % 7 - 3) AS b, o_custkey AS f FROM orders), q AS (SELECT quantile_cont(a, 0.25) AS qa, quantile_cont(f, 0.75) AS qf FROM p)"


@query(
    f"WITH {_PAIRS}, s AS (SELECT 'all' AS stratum, * FROM p UNION ALL SELECT 'control_low', p.* FROM p, q WHERE a <= qa UNION ALL SELECT 'feature_high', p.* FROM p, q WHERE f >= qf) "
    "SELECT stratum, count(*) AS images, round(avg(a), 6) AS control_score, round(avg(b), 6) AS candidate_score, round(avg(b - a), 6) AS delta_score, count(*) FILTER (b - a > 1e-12) AS improved, count(*) FILTER (b - a < -1e-12) AS worse FROM s GROUP BY stratum"
)
def paired_strata(spark, sf_dir):
    from ..operators import aggregate

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_custkey").cast("double").alias("f"))
    rows = compare.paired(o, o.select("image", (F.col("score") + (F.col("image") % 7 - 3)).alias("score")), "image", ["score"]).join(o.select("image", "f"), "image")
    q = aggregate.quartiles(rows, ["control_score", "f"])
    strata = {"all": F.lit(True), "control_low": F.col("control_score") <= q["control_score"][0], "feature_high": F.col("f") >= q["f"][1]}
    return _round(compare.paired_strata(rows, strata, ["score"]), "control_score", "candidate_score", "delta_score")


_COUNTED = "c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, count(*) OVER () AS n, 20 + c_custkey % 50 AS n_gt, 25 + c_custkey % 40 AS n_det, 15 + c_custkey % 5 AS tp, (c_custkey % 4)::DOUBLE AS gr, (c_custkey % 3)::DOUBLE AS gp, 16 + c_custkey % 5 AS tp2, (c_custkey % 2)::DOUBLE AS gr2 FROM customer)"


@query(
    f"WITH {_COUNTED}, i AS (SELECT r AS resample, ((r * 7919 + k * 104729 + r * k * 31) % (SELECT max(n) FROM c)) AS row FROM range(100) a(r), (SELECT unnest(range(max(n))) AS k FROM c) b), s AS (SELECT resample, sum(n_gt) AS g, sum(n_det) AS d, sum(tp) AS t, sum(gr) AS r, sum(gp) AS p, sum(tp2) AS t2, sum(gr2) AS r2 FROM i JOIN c USING (row) GROUP BY resample), "
    "x AS (SELECT greatest(0, t - r) / g AS ra, greatest(0, t - p) / d AS pa, greatest(0, t2 - r2) / g AS rb, greatest(0, t2 - p) / d AS pb FROM s), u AS (SELECT 'global_recall' AS metric, rb - ra AS v FROM x UNION ALL SELECT 'global_precision', pb - pa FROM x UNION ALL SELECT 'global_hmean', 2 * rb * pb / (rb + pb) - 2 * ra * pa / (ra + pa) FROM x) "
    "SELECT metric, round(avg(v), 6) AS delta_mean, round(quantile_cont(v, 0.025), 6) AS ci95_low, round(quantile_cont(v, 0.975), 6) AS ci95_high, round(avg((v > 0)::INT), 6) AS probability_gt_0 FROM u GROUP BY metric"
)
def bootstrap_global_fixed(spark, sf_dir):
    """Global scores of resampled counters of two methods, drawn by a formula, all rows in each resample."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey")
    n = base.count()
    one = {"n_gt": 20 + k % 50, "n_det": 25 + k % 40, "tp": 15 + k % 5, "gran_recall": (k % 4).cast("double"), "gran_precision": (k % 3).cast("double")}
    two = one | {"tp": 16 + k % 5, "gran_recall": (k % 2).cast("double")}
    rows = base.select("c_custkey", *(c.alias(f"a_{m}") for m, c in one.items()), *(c.alias(f"b_{m}") for m, c in two.items()))
    numbered = ranking.global_rank(rows, ["c_custkey"], "row").withColumn("row", F.col("row") - 1)
    indices = compare.drawn_indices(spark, 100, n)
    out = compare.bootstrap_global(numbered, indices, ("a", "b"), list(one), cleval.with_scores)
    return _round(out, "delta_mean", "ci95_low", "ci95_high", "probability_gt_0")
