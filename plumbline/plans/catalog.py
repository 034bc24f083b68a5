"""The registered queries of the evaluation engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import aggregate, cleval, compare, ranking, split, validate
from ..sources import annotations, sinks
from . import boxes as B
from .boxes import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import coverage, files, measures  # noqa: F401 (register more)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import coverage, files, measures  # noqa: F401

    return dict(_SQL)


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns))


SCORES = ("recall", "precision", "hmean")


def _sides(spark, sf_dir, dont_care=None):
    rows = B.lines(spark, sf_dir)
    return B.ground_truth(rows, dont_care), B.detections(rows)


def _rounded(names, prefix="") -> str:
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


# Evaluation

_PER = f"WITH {B.sides()}, {B.related()}, {B.counted()}"
_COUNTERS = "n_gt, n_det, tp, fp, overlapped, gran_recall, gran_precision, n_split, n_merged"


@query(f"{_PER} SELECT image, {_COUNTERS}, {_rounded(SCORES)} FROM per")
def cleval_per_image(spark, sf_dir):
    return _round(cleval.evaluate_boxes(*_sides(spark, sf_dir)), *SCORES)


_DC = f"WITH {B.sides('l_linenumber = 3')}, {B.related(lost=True)}, {B.counted()}"


@query(f"{_DC} SELECT image, {_COUNTERS}, {_rounded(SCORES)} FROM per")
def cleval_dont_care(spark, sf_dir):
    return _round(cleval.evaluate_boxes(*_sides(spark, sf_dir, F.col("l_linenumber") == 3)), *SCORES)


@query(
    f"{_PER}, g AS ({B.scored('(SELECT ' + B.COUNTER_SUMS + ' FROM per)')}) SELECT (SELECT count(*) FROM per) AS images, "
    "(SELECT round(avg(recall), 6) FROM per) AS macro_recall, (SELECT round(avg(precision), 6) FROM per) AS macro_precision, (SELECT round(avg(hmean), 6) FROM per) AS macro_hmean, "
    f"round(recall, 6) AS global_recall, round(precision, 6) AS global_precision, round(hmean, 6) AS global_hmean, {_COUNTERS} FROM g"
)
def cleval_macro_global(spark, sf_dir):
    out = cleval.report(cleval.evaluate_boxes(*_sides(spark, sf_dir)))
    return _round(out, *(f"{p}_{s}" for p in ("macro", "global") for s in SCORES))


@query(f"WITH {B.sides()}, {B.related()} SELECT count(*) AS pairs, sum(o2o::INT)::BIGINT AS one_to_one, sum(o2m::INT)::BIGINT AS one_to_many, sum(m2o::INT)::BIGINT AS many_to_one, sum((o2o OR o2m OR m2o)::INT)::BIGINT AS matched FROM r WHERE n > 0 OR ap > 0")
def cleval_match_relations(spark, sf_dir):
    related = cleval.with_relations(cleval.box_pairs(*_sides(spark, sf_dir))).where((F.size("hits") > 0) | (F.col("ap") > 0))
    return related.agg(F.count("*").alias("pairs"), *(F.count_if(F.col(c)).alias(c) for c in ("one_to_one", "one_to_many", "many_to_one", "matched")))


THRESHOLDS = (0.0, 0.02, 0.04, 0.06, 0.08)


@query(
    f"WITH {B.sides(thresholds='0.0::DOUBLE, 0.02::DOUBLE, 0.04::DOUBLE, 0.06::DOUBLE, 0.08::DOUBLE')}, {B.related('threshold, image')}, {B.counted('threshold, image')}, "
    f"g AS ({B.scored('(SELECT threshold, count(*) AS images, avg(hmean) AS macro_hmean, ' + B.COUNTER_SUMS + ' FROM per GROUP BY threshold)')}) "
    f"SELECT threshold, images, round(macro_hmean, 6) AS macro_hmean, round(hmean, 6) AS global_hmean, {_COUNTERS} FROM g"
)
def threshold_sweep(spark, sf_dir):
    rows = B.lines(spark, sf_dir)
    per = cleval.sweep_boxes(B.ground_truth(rows), B.detections(rows, "l_discount"), "l_discount", list(THRESHOLDS))
    out = cleval.report(per, "threshold").select("threshold", "images", "macro_hmean", "global_hmean", *cleval.COUNTERS)
    return _round(out, "macro_hmean", "global_hmean")


_CAP = "SELECT image, k, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY l_extendedprice DESC, k) AS n FROM li) WHERE n <= 3"


@query(f"WITH {B.LINES} {_CAP}")
def confidence_cap(spark, sf_dir):
    rows = B.lines(spark, sf_dir).select("image", "k", "l_extendedprice")
    return cleval.cap_boxes(rows, [F.desc("l_extendedprice"), "k"], 3)


# Boxes and polygons

_IOU = """ious AS (SELECT image, i, j, CASE WHEN u > 0 THEN s / u ELSE 0 END AS iou FROM (
  SELECT *, (ax1 - ax0) * 10 + (bx1 - bx0) * 10 - s AS u FROM (
    SELECT a.image, a.g AS i, b.d AS j, a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * 10 AS s
    FROM gt a JOIN det b USING (image))) WHERE CASE WHEN u > 0 THEN s / u ELSE 0 END >= 0.5::DOUBLE)"""


def _iou_sides(spark, sf_dir):
    box = F.struct("x0", "y0", "x1", "y1").alias("box")
    gt, det = _sides(spark, sf_dir)
    return gt.select("image", F.col("g").alias("i"), box), det.select("image", F.col("d").alias("j"), box)


@query(f"WITH {B.sides()}, {_IOU} SELECT image, i, j, round(iou, 6) AS iou FROM ious")
def box_pair_iou(spark, sf_dir):
    return _round(compare.iou_candidates(*_iou_sides(spark, sf_dir)), "iou")


_GREEDY = (
    f"WITH RECURSIVE {B.sides()}, {_IOU}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, i, j) AS n FROM ious), "
    "st AS (SELECT DISTINCT image, 0::BIGINT AS n, []::BIGINT[] AS li, []::BIGINT[] AS ri, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS iou FROM o "
    "UNION ALL SELECT o.image, o.n, CASE WHEN ok THEN list_append(s.li, o.i) ELSE s.li END, CASE WHEN ok THEN list_append(s.ri, o.j) ELSE s.ri END, CASE WHEN ok THEN o.i END, CASE WHEN ok THEN o.j END, CASE WHEN ok THEN o.iou END "
    "FROM (SELECT st.*, 1 AS one FROM st) s JOIN o ON o.image = s.image AND o.n = s.n + 1 CROSS JOIN LATERAL (SELECT NOT list_contains(s.li, o.i) AND NOT list_contains(s.ri, o.j) AS ok) z) "
)


@query(_GREEDY + "SELECT image, i, j, round(iou, 6) AS iou FROM st WHERE i IS NOT NULL")
def greedy_match(spark, sf_dir):
    return _round(compare.greedy_match(compare.iou_candidates(*_iou_sides(spark, sf_dir))), "iou")


@query(
    _GREEDY + ", m AS (SELECT image, count(i) AS matched, avg(iou) AS iou FROM st GROUP BY image), n AS (SELECT image, count(*) AS n FROM gt GROUP BY image) "
    "SELECT image, n AS n_a, n AS n_b, coalesce(matched, 0) AS matched, n - coalesce(matched, 0) AS only_a, n - coalesce(matched, 0) AS only_b, round(coalesce(iou, 0), 6) AS mean_iou, round(coalesce(matched, 0) / greatest(2 * n - coalesce(matched, 0), 1), 6) AS jaccard FROM n LEFT JOIN m USING (image)"
)
def match_report(spark, sf_dir):
    a, b = _iou_sides(spark, sf_dir)
    return _round(compare.match_report(a, b, compare.greedy_match(compare.iou_candidates(a, b))), "mean_iou", "jaccard")


@query(_GREEDY + ", m AS (SELECT image, count(i) AS matched FROM st GROUP BY image), n AS (SELECT image, count(*) AS boxes FROM gt GROUP BY image) SELECT image, boxes, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / greatest(2 * boxes - coalesce(matched, 0), 1), 6) AS jaccard FROM n LEFT JOIN m USING (image)")
def box_jaccard(spark, sf_dir):
    a, b = _iou_sides(spark, sf_dir)
    out = compare.match_report(a, b, compare.greedy_match(compare.iou_candidates(a, b)))
    return _round(out.select("image", F.col("n_a").alias("boxes"), "matched", "jaccard"), "jaccard")


def _pentagon(df: DataFrame) -> DataFrame:
    """A five-cornered polygon of each line: a box with a roof."""
    x, w = 25.0 * F.col("k"), F.col("l_quantity")
    p = F.array(G.point(x, 2.0), G.point(x + w / 2, -100.0 * F.col("l_tax")), G.point(x + w, 2.0), G.point(x + w, 10.0), G.point(x, 10.0))
    return df.select("image", "k", "l_discount", p.alias("polygon"))


_PENTAGON = "pg AS (SELECT image, k, l_discount, 25.0::DOUBLE * k AS x, l_quantity AS w, -100.0::DOUBLE * l_tax AS top FROM li)"


@query(f"WITH {B.LINES}, {_PENTAGON} SELECT image, k, round(w * 8 + w * (2 - top) / 2, 6) AS area, round(2 * 8 + w + 2 * sqrt(w * w / 4 + (2 - top) * (2 - top)), 6) AS perimeter FROM pg")
def polygon_area_shoelace(spark, sf_dir):
    p = _pentagon(B.lines(spark, sf_dir))
    return p.select("image", "k", F.round(G.area(F.col("polygon")), 6).alias("area"), F.round(G.perimeter(F.col("polygon")), 6).alias("perimeter"))


@query(
    f"WITH {B.LINES}, {_PENTAGON} SELECT image, k, (px >= x AND px < x + w AND py < 10 AND py >= 2) OR (py < 2 AND py >= top AND px >= x + w / 2 * (2 - py) / (2 - top) AND px < x + w - w / 2 * (2 - py) / (2 - top)) AS inside "
    "FROM (SELECT *, x + 400.0::DOUBLE * l_discount + 0.37::DOUBLE AS px, top + (k % 7) * 1.7::DOUBLE + 0.13::DOUBLE AS py FROM pg)"
)
def point_in_polygon(spark, sf_dir):
    p = _pentagon(B.lines(spark, sf_dir).withColumn("l_discount", F.col("l_discount")))
    top = F.col("polygon")[1]["y"]
    px, py = 25.0 * F.col("k") + 400.0 * F.col("l_discount") + 0.37, top + (F.col("k") % 7) * 1.7 + 0.13
    return p.select("image", "k", G.contains(F.col("polygon"), px, py).alias("inside"))


@query(f"WITH {B.LINES} SELECT image, k, round((2 * x + 0.5 * y + 3) / d, 6) AS x, round((-0.25 * x + 1.5 * y - 7) / d, 6) AS y FROM (SELECT image, k, x, y, 0.001 * x + 0.002 * y + 1 AS d FROM (SELECT image, k, 25.0::DOUBLE * k AS x, l_quantity AS y FROM li))")
def homography_apply(spark, sf_dir):
    m = F.array(*(F.lit(v) for v in (2.0, 0.5, 3.0, -0.25, 1.5, -7.0, 0.001, 0.002, 1.0)))
    p = B.lines(spark, sf_dir).select("image", "k", G.apply_homography(m, 25.0 * F.col("k"), F.col("l_quantity")).alias("p"))
    return p.select("image", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {B.LINES}, {_PENTAGON} SELECT image, k, round(greatest(0, -x, -top, x + w - 119, 10 - 8), 6) AS overshoot FROM pg")
def boundary_overshoot(spark, sf_dir):
    p = _pentagon(B.lines(spark, sf_dir))
    return p.select("image", "k", F.round(G.overshoot(F.col("polygon"), F.lit(120), F.lit(9)), 6).alias("overshoot"))


@query(
    f"WITH {B.LINES}, {_PENTAGON}, o AS (SELECT *, greatest(0, -x, -top, x + w - 119, 10 - 8) AS over FROM pg), n AS (SELECT image, count(*) AS polygons, count(*) - count(DISTINCT (x, w, top)) AS dup FROM o GROUP BY image) "
    "SELECT (SELECT count(*) FROM n) AS images, (SELECT count(*) FROM o) AS polygons, 0::BIGINT AS short_polygons, 0::BIGINT AS bad_numbers, 0::BIGINT AS zero_area, 0::BIGINT AS invalid_geometry, (SELECT sum(dup) FROM n)::BIGINT AS duplicate_polygons, "
    "(SELECT count(*) FROM o WHERE over > 0) AS outside, (SELECT count(*) FROM o WHERE over > 8) AS far_outside, (SELECT count(*) FROM n WHERE polygons > 500) AS full_images, (SELECT count(*) FROM o WHERE over > 8) = 0 AS passed"
)
def polygon_validator(spark, sf_dir):
    p = _pentagon(B.lines(spark, sf_dir))
    return validate.passed(validate.polygon_checks(p, F.lit(120), F.lit(9)))


@query(
    f"WITH {B.LINES}, {_PENTAGON}, o AS (SELECT *, (top < 0 OR x + w >= 120 OR 10 >= 9) AS oob FROM pg), n AS (SELECT image, count(*) AS polygons, sum(oob::INT) AS oob FROM o GROUP BY image) "
    "SELECT count(*) AS images, sum(polygons)::BIGINT AS polygons, 5::INT AS least_points, 0::BIGINT AS short_polygons, sum(oob)::BIGINT AS out_polygons, sum((oob > 0)::INT)::BIGINT AS out_images, sum((polygons > 500)::INT)::BIGINT AS full_images, max(polygons) AS most_polygons FROM n"
)
def oob_sanity(spark, sf_dir):
    return aggregate.sanity(_pentagon(B.lines(spark, sf_dir)), F.lit(120), F.lit(9))


# Profiles, ranks, strata


@query(
    "SELECT o_orderpriority, count(*) AS rows, round(quantile_cont(o_totalprice, 0.5), 6) AS o_totalprice_median, round(quantile_cont(o_totalprice, 0.1), 6) AS o_totalprice_q10, round(quantile_cont(o_totalprice, 0.9), 6) AS o_totalprice_q90 FROM orders GROUP BY 1"
)
def group_profile(spark, sf_dir):
    out = aggregate.profile(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])
    return _round(out, *(c for c in out.columns if c.startswith("o_total")))


@query("SELECT o_orderstatus, count(*) AS rows, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def row_aggregates(spark, sf_dir):
    out = aggregate.summary(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return out.select("o_orderstatus", "rows", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"), "least", "most", F.round("median", 6).alias("median"))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def normalised_counts(spark, sf_dir):
    return _round(aggregate.shares(table(spark, sf_dir, "orders"), ["o_orderpriority"]), "share")


@query(
    "SELECT c_custkey, c_acctbal, r AS rank, greatest(((r - 1) * 5 + n - 2) // (n - 1) - 1, 0)::INT AS bin5, greatest(((r - 1) * 2 + n - 2) // (n - 1) - 1, 0)::INT AS bin2 FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer)"
)
def rank_bins(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    n = F.lit(customers.count())
    ranked = ranking.rank_first(customers, "c_acctbal", ["c_custkey"])
    return ranked.withColumn("bin5", ranking.quantile_bin(F.col("rank"), n, 5)).withColumn("bin2", ranking.quantile_bin(F.col("rank"), n, 2))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranking.top_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query(
    "SELECT event_type, event_id, value, q AS quantile FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q) WHERE k = round_even(q * (n - 1), 0)"
)
def quantile_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return ranking.quantile_pick(rows, ["event_type"], ["value", "event_id"], [0.1, 0.5, 0.9])


@query("SELECT event_type, event_id, round((row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) / (count(*) OVER (PARTITION BY event_type) - 1), 6) AS ecdf FROM events")
def ecdf(spark, sf_dir):
    out = ranking.ecdf(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], ["value", "event_id"])
    return _round(out.drop("value"), "ecdf")


@query(
    "WITH o AS (SELECT o_totalprice AS v, c_acctbal AS b, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.75) AS v3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM o), "
    "s AS (SELECT 'all' AS stratum, v, b FROM o UNION ALL SELECT 'price_low', v, b FROM o, q WHERE v <= v1 UNION ALL SELECT 'price_high', v, b FROM o, q WHERE v >= v3 UNION ALL SELECT 'balance_low', v, b FROM o, q WHERE b <= b1 UNION ALL SELECT 'balance_high', v, b FROM o, q WHERE b >= b3 "
    "UNION ALL SELECT 'segment_' || c_mktsegment, v, b FROM o) SELECT stratum, count(*) AS rows, round(avg(v), 4) AS mean_price, round(avg(b), 4) AS mean_balance FROM s GROUP BY 1"
)
def strata_report(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    q = aggregate.quartiles(rows, ["o_totalprice", "c_acctbal"])
    v, b = F.col("o_totalprice"), F.col("c_acctbal")
    named = {"all": F.lit(True), "price_low": v <= q["o_totalprice"][0], "price_high": v >= q["o_totalprice"][1], "balance_low": b <= q["c_acctbal"][0], "balance_high": b >= q["c_acctbal"][1]}
    measures = [F.count("*").alias("rows"), F.round(F.avg(v), 4).alias("mean_price"), F.round(F.avg(b), 4).alias("mean_balance")]
    return aggregate.strata(rows, named, measures, {"segment_": "c_mktsegment"})


_FOLD = "o AS (SELECT *, (o_custkey % 5)::INT AS fold FROM orders)"


def _folds(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("fold", (F.col("o_custkey") % 5).cast("int"))


@query(
    f"WITH {_FOLD}, m AS (SELECT fold, avg(o_totalprice) AS price, count(DISTINCT o_custkey)::DOUBLE AS customers FROM o GROUP BY fold), u AS (SELECT 'price' AS metric, price AS value FROM m UNION ALL SELECT 'customers', customers FROM m) SELECT metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS least, round(max(value), 4) AS most FROM u GROUP BY metric"
)
def fold_stability(spark, sf_dir):
    folds = _folds(spark, sf_dir).groupBy("fold").agg(F.avg("o_totalprice").alias("price"), F.count_distinct("o_custkey").cast("double").alias("customers"))
    return _round(aggregate.stability(folds, ["price", "customers"]), "mean", "std", "least", "most", digits=4)


@query(
    f"WITH {_FOLD}, u AS (SELECT fold, 'price' AS feature, o_totalprice AS v FROM o UNION ALL SELECT fold, 'key', o_orderkey::DOUBLE FROM o), m AS (SELECT feature, fold, avg(v) AS m FROM u GROUP BY ALL), e AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS s FROM u GROUP BY ALL) SELECT feature, round(max(CASE WHEN s > 0 THEN abs(m - a) / s ELSE 0 END), 6) AS max_z FROM m JOIN e USING (feature) GROUP BY feature"
)
def fold_balance(spark, sf_dir):
    rows = _folds(spark, sf_dir).select("fold", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))
    return _round(aggregate.balance(rows, "fold", ["price", "key"]), "max_z")


@query(f"WITH {_FOLD} SELECT fold, o_orderpriority, coalesce(n, 0) AS n FROM (SELECT DISTINCT fold FROM o) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM o) LEFT JOIN (SELECT fold, o_orderpriority, count(*) AS n FROM o GROUP BY ALL) USING (fold, o_orderpriority)")
def fold_crosstab(spark, sf_dir):
    return aggregate.cross_table(_folds(spark, sf_dir), "fold", "o_orderpriority")


@query(f"WITH {_FOLD} SELECT f::INT AS fold, coalesce(n, 0) AS n FROM range(7) t(f) LEFT JOIN (SELECT fold, count(*) AS n FROM o GROUP BY fold) ON f = fold")
def fold_counts_dense(spark, sf_dir):
    return aggregate.dense_groups(_folds(spark, sf_dir), "fold", 7)


@query(f"WITH {_FOLD} SELECT fold, count(*) AS rows, count(DISTINCT o_custkey) AS groups, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM o GROUP BY fold")
def fold_summary(spark, sf_dir):
    out = aggregate.fold_summary(_folds(spark, sf_dir), "fold", "o_custkey", "o_totalprice", ["o_totalprice"])
    return out.select("fold", "rows", "groups", F.round("total", 2).alias("total"), F.round("mean_o_totalprice", 4).alias("mean_o_totalprice"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def duplicate_count(spark, sf_dir):
    return aggregate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


# Drift, correlation, comparison

_DRIFT = """WITH e AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), t AS (SELECT DISTINCT g FROM e WHERE g <> (SELECT min(g) FROM e)),
u AS (SELECT t.g, e.v, 1 AS a, 0 AS b FROM e, t WHERE e.g = (SELECT min(g) FROM e) UNION ALL SELECT g, v, 0, 1 FROM e WHERE g IN (SELECT g FROM t)),
m AS (SELECT g, v, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL),
w AS (SELECT g, v, sum(a) OVER x AS ca, sum(b) OVER x AS cb, sum(a) OVER y AS na, sum(b) OVER y AS nb, lead(v) OVER (PARTITION BY g ORDER BY v) AS nv FROM m WINDOW x AS (PARTITION BY g ORDER BY v), y AS (PARTITION BY g)),
d AS (SELECT *, abs(ca / na - cb / nb) AS dist FROM w),
s AS (SELECT g, max(na)::BIGINT AS n_reference, max(nb)::BIGINT AS n_target, max(dist) AS ks, sum(dist * (coalesce(nv, v) - v)) AS w1 FROM d GROUP BY g),
r AS (SELECT median(v) AS rm, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM e WHERE g = (SELECT min(g) FROM e)),
q AS (SELECT g, median(v) AS tm FROM e GROUP BY g) """


def _first_type(df):
    return df.agg(F.min("event_type")).first()[0]


def _drift(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return compare.drift(events, "event_type", "value", _first_type(events))


@query(_DRIFT + "SELECT g AS event_type, n_reference, n_target, round(ks, 6) AS ks_statistic FROM s")
def drift_ks(spark, sf_dir):
    return _round(_drift(spark, sf_dir).select("event_type", "n_reference", "n_target", "ks_statistic"), "ks_statistic")


@query(_DRIFT + "SELECT g AS event_type, round(rm, 6) AS reference_median, round(tm, 6) AS target_median, round(tm - rm, 6) AS median_delta, round(w1, 6) AS wasserstein, round(w1 / greatest(iqr, 1e-12), 6) AS wasserstein_over_iqr FROM s JOIN q USING (g), r")
def drift_wasserstein(spark, sf_dir):
    names = ("reference_median", "target_median", "median_delta", "wasserstein", "wasserstein_over_iqr")
    return _round(_drift(spark, sf_dir).select("event_type", *names), *names)


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT round(corr(a, b), 6) AS rho, count(*) AS samples FROM r")
def spearman(spark, sf_dir):
    return _round(compare.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("rho", "samples"), "rho")


@query("SELECT count(*) AS rows, round(corr(p_retailprice, p_size), 6) AS pearson, round(avg(abs(p_retailprice - p_size)), 4) AS mae, round(sqrt(avg((p_retailprice - p_size) * (p_retailprice - p_size))), 4) AS rmse FROM part")
def calibration_stats(spark, sf_dir):
    out = compare.calibration(table(spark, sf_dir, "part").select(F.col("p_retailprice"), F.col("p_size").cast("double").alias("p_size")), "p_retailprice", "p_size")
    return out.select("rows", F.round("pearson", 6).alias("pearson"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


_PAIRED = "p AS (SELECT o_orderkey AS image, o_totalprice / 1000 AS a, o_totalprice / 1000 + (o_orderkey % 7 - 3) AS b FROM orders)"


def _paired(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_totalprice") / 1000).alias("score"))
    candidate = rows.select("image", (F.col("score") + (F.col("image") % 7 - 3)).alias("score"))
    return compare.paired(rows, candidate, "image", ["score"])


@query(f"WITH {_PAIRED} SELECT image, round(a, 6) AS control_score, round(b, 6) AS candidate_score, round(b - a, 6) AS delta_score FROM p")
def paired_delta(spark, sf_dir):
    return _round(_paired(spark, sf_dir), "control_score", "candidate_score", "delta_score")


@query(f"WITH {_PAIRED} SELECT count(*) FILTER (b - a > 1e-12) AS wins, count(*) FILTER (b - a < -1e-12) AS losses, count(*) FILTER (abs(b - a) <= 1e-12) AS ties, round(avg(greatest(a, b)), 6) AS oracle_mean FROM p")
def oracle_choice(spark, sf_dir):
    return _round(compare.win_loss(_paired(spark, sf_dir), "score"), "oracle_mean")


@query()
def paired_bootstrap(spark, sf_dir):
    return _round(compare.bootstrap_means(_paired(spark, sf_dir), "image", ["delta_score", "candidate_score"]), "delta_mean", "ci95_low", "ci95_high", "probability_gt_0")


@query(
    "WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, n_chars::DOUBLE AS x, count(*) OVER () AS n FROM documents), i AS (SELECT r AS resample, k, ((r * 7919 + k * 104729 + r * k * 31) % (SELECT max(n) FROM d)) AS row FROM range(200) a(r), (SELECT unnest(range(max(n))) AS k FROM d) b), "
    "m AS (SELECT resample, avg(x) AS v FROM i JOIN d USING (row) GROUP BY resample) SELECT 'n_chars' AS metric, round(avg(v), 4) AS delta_mean, round(quantile_cont(v, 0.025), 4) AS ci95_low, round(quantile_cont(v, 0.975), 4) AS ci95_high, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS probability_gt_0 FROM m"
)
def paired_bootstrap_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    n = docs.count()
    rows = ranking.global_rank(docs, ["doc_id"], "row").withColumn("row", F.col("row") - 1)
    indices = compare.drawn_indices(spark, 200, n)
    out = compare.bootstrap_indexed(rows, indices, "n_chars")
    return _round(out, "delta_mean", "ci95_low", "ci95_high", digits=4)


# Duplicates, components, folds


@query("WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS group_id, count(*) OVER (PARTITION BY sha256) AS group_size FROM h")
def exact_dup_groups(spark, sf_dir):
    return split.exact_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


_BITS = "v AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0.12 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)) AS u FROM embeddings)"


def _hashed(spark, sf_dir):
    """A 64-bit hash of each vector: which of its components are large."""
    bit = lambda x, i: F.when(x > F.lit(0.12), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("phash"))


@query(f"WITH {_BITS} SELECT a.vec_id AS left, b.vec_id AS right, bit_count(xor(a.u, b.u))::INT AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.u, b.u)) <= 8")
def near_dup_pairs(spark, sf_dir):
    return split.every_near_pair(_hashed(spark, sf_dir), "vec_id", "phash", 8)


@query(
    f"WITH RECURSIVE {_BITS}, e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE bit_count(xor(a.u, b.u)) <= 8), c AS (SELECT x AS node, x AS reach FROM e UNION SELECT c.node, e.y FROM c JOIN e ON c.reach = e.x) SELECT node, min(reach) AS label FROM c GROUP BY node"
)
def connected_components(spark, sf_dir):
    return split.components(split.near_pairs(_hashed(spark, sf_dir), "vec_id", "phash", 8))


@query(
    "WITH p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), m AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my FROM p) "
    "SELECT l AS left, r AS right, round(list_inner_product(list_transform(x, lambda v: v - mx), list_transform(y, lambda v: v - my)) / (sqrt(list_sum(list_transform(x, lambda v: (v - mx) * (v - mx)))) * sqrt(list_sum(list_transform(y, lambda v: (v - my) * (v - my))))), 6) AS correlation FROM m"
)
def vector_corr_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = v.join(right, "vec_id").select(F.col("vec_id").alias("left"), (F.col("vec_id") + 1).alias("right"), S.centred_cosine(F.col("embedding"), F.col("other")).alias("correlation"))
    return _round(out, "correlation")


def _documents_with_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("stratum", F.concat_ws("_", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("none"))))


@query()
def group_kfold(spark, sf_dir):
    rows = _documents_with_labels(spark, sf_dir).withColumn("group", F.concat_ws("/", "source", (F.col("doc_id") % 16).cast("string")))
    return split.group_kfold(rows, "group", "stratum", 5, blocks=1).select("doc_id", "group", "stratum", "fold")


@query("WITH d AS (SELECT source, (doc_id % 3)::INT AS fold FROM documents), g AS (SELECT source, count(DISTINCT fold) AS f FROM d GROUP BY source) SELECT count(*) AS groups, count(*) FILTER (f > 1) AS leaking FROM g")
def leakage_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).cast("int").alias("fold"))
    return validate.leakage(docs, "fold", "source")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra")
def anti_join_coverage(spark, sf_dir):
    return validate.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def outer_contract_join(spark, sf_dir):
    return validate.join_indicator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query()
def weighted_family_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return split.weighted_sample(docs, "source", docs.count(), key="doc_id")


@query("WITH o AS (SELECT avg(o_totalprice) AS m, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders) SELECT n > 1000 AS enough_rows, m > 0 AS positive_mean, c < n AS customers_repeat, (n > 1000 AND m > 0 AND c < n) AS passed FROM o")
def gate_report(spark, sf_dir):
    row = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("c"))
    return validate.gates(row, {"enough_rows": F.col("n") > 1000, "positive_mean": F.col("m") > 0, "customers_repeat": F.col("c") < F.col("n")})


# Text, JSON, submissions


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_props_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"))


_ENCODED = "enc AS (SELECT image, string_agg(concat_ws(' ', x0, y0, x1, y0, x1, y1, x0, y1), '|' ORDER BY k) AS polygons FROM (SELECT image, k, (25 * k)::BIGINT AS x0, 0 AS y0, (25 * k + l_quantity)::BIGINT AS x1, 10 AS y1 FROM li) GROUP BY image)"


def _encoded(spark, sf_dir):
    x0, w = (25 * F.col("k")).cast("long"), F.col("l_quantity")
    x1 = (25 * F.col("k") + w).cast("long")
    flat = F.array(x0, F.lit(0).cast("long"), x1, F.lit(0).cast("long"), x1, F.lit(10).cast("long"), x0, F.lit(10).cast("long"))
    return sinks.submission(B.lines(spark, sf_dir).select("image", "k", flat.alias("flat")))


@query(f"WITH {B.LINES}, {_ENCODED} SELECT image AS filename, polygons FROM enc")
def submission_encode(spark, sf_dir):
    return _encoded(spark, sf_dir)


@query(f"WITH {B.LINES} SELECT image AS filename, count(*)::INT AS polygons, sum(2 * (25 * k)::DOUBLE + 2 * (25 * k + l_quantity)) AS x_sum FROM li GROUP BY image")
def submission_decode(spark, sf_dir):
    sets = _encoded(spark, sf_dir).select("filename", annotations.decode_polygons(F.col("polygons")).alias("sets"))
    xs = F.flatten(F.transform("sets", lambda v: F.filter(v, lambda _, i: i % 2 == 0)))
    return sets.select("filename", F.size("sets").alias("polygons"), F.aggregate(xs, F.lit(0.0), lambda s, x: s + x).alias("x_sum"))


@query(f"WITH {B.LINES}, {_ENCODED} SELECT count(*) AS rows, 0::BIGINT AS duplicate_rows, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS bad_sets, 0::BIGINT AS infinite_sets, 0::BIGINT AS count_mismatches FROM enc")
def submission_csv_checks(spark, sf_dir):
    expected = B.lines(spark, sf_dir).groupBy(F.col("image").alias("filename")).agg(F.count("*").alias("n"))
    return validate.csv_checks(_encoded(spark, sf_dir), expected)


@query()
def prediction_json(spark, sf_dir):
    p = _pentagon(B.lines(spark, sf_dir))
    return sinks.prediction_json(p)


@query(
    "WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT lang, ch, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM n) SELECT lang, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY lang"
)
def entropy_chars(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    n = chars.groupBy("lang", "ch").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("lang")))
    return p.groupBy("lang").agg(F.round(F.sum(S.entropy_bits(F.col("p"))), 6).alias("entropy"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice / (o_orderkey % 3), 6) ELSE 0 END AS safe, round(CASE WHEN o_totalprice + o_custkey = 0 THEN 0 ELSE 2 * o_totalprice * o_custkey / (o_totalprice + o_custkey) END, 6) AS harmonic, round(abs(o_totalprice - o_custkey) / greatest(abs(o_totalprice), abs(o_custkey), 1e-12), 6) AS relative, round_even(o_custkey / 2, 0) AS half_even, printf('%04d', o_custkey) AS padded, round(ln(1 + o_totalprice), 6) AS log1p, upper(o_orderpriority) AS folded FROM orders")
def scalar_functions(spark, sf_dir):
    o, key, cust, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return o.select(
        "o_orderkey", F.round(S.safe_divide(price, key % 3), 6).alias("safe"), F.round(S.harmonic_mean(price, cust), 6).alias("harmonic"), F.round(S.relative_difference(price, cust.cast("double")), 6).alias("relative"),
        S.half_even(cust / 2).alias("half_even"), S.padded_index(cust).alias("padded"), F.round(F.log1p(price), 6).alias("log1p"), F.upper("o_orderpriority").alias("folded"),
    )


# Selection, integrity, images

_TOTALS = (
    f"WITH {B.sides(thresholds='0.0::DOUBLE, 0.05::DOUBLE')}, {B.related('threshold, image')}, {B.counted('threshold, image')}, t AS (SELECT threshold, {B.COUNTER_SUMS} FROM per GROUP BY threshold), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS counter, threshold, {c}::DOUBLE AS v FROM t" for c in cleval.COUNTERS) + ") "
)


@query(_TOTALS + "SELECT counter, max(v) FILTER (threshold = 0) AS control, max(v) FILTER (threshold > 0) AS candidate, max(v) FILTER (threshold > 0) - max(v) FILTER (threshold = 0) AS delta FROM u GROUP BY counter")
def counter_diagnosis(spark, sf_dir):
    from ..operators.selection import counter_diagnosis as diagnose

    rows = B.lines(spark, sf_dir)
    per = cleval.sweep_boxes(B.ground_truth(rows), B.detections(rows, "l_discount"), "l_discount", [0.0, 0.05])
    totals = cleval.total(per, "threshold")
    return diagnose(totals, "threshold", 0.0, 0.05, list(cleval.COUNTERS))


@query(
    f"WITH {B.sides()}, k AS (SELECT DISTINCT image, x0, y0, x1, y1 FROM det JOIN (SELECT image, k AS d, l_discount FROM li) USING (image, d) WHERE l_discount >= 0.05 AND x1 - x0 >= 10), n AS (SELECT *, count(*) OVER (PARTITION BY image) AS c FROM k) "
    "SELECT image, count(*) AS boxes, round(sum(x1 - x0), 4) AS width FROM n WHERE c <= 3 GROUP BY image"
)
def pseudo_label_filter(spark, sf_dir):
    from ..operators.selection import pseudo_labels

    kept = pseudo_labels(B.detections(B.lines(spark, sf_dir), "l_discount"), "l_discount", 0.05, 10.0, 3)
    return kept.groupBy("image").agg(F.count("*").alias("boxes"), F.round(F.sum(F.col("x1") - F.col("x0")), 4).alias("width"))


@query(
    f"WITH RECURSIVE {B.sides()}, e AS (SELECT image, a.d AS p, b.d AS q FROM det a JOIN det b USING (image) WHERE a.d <> b.d AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * 10 >= 0.2::DOUBLE * ((a.x1 - a.x0) * 10 + (b.x1 - b.x0) * 10 - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * 10) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)), "
    "c AS (SELECT image, d, d AS reach FROM det UNION SELECT c.image, c.d, e.q FROM c JOIN e ON c.image = e.image AND c.reach = e.p), h AS (SELECT image, d, min(reach) AS head FROM c GROUP BY ALL) "
    "SELECT image, head, round(min(x0), 6) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, max(y1) AS y1, count(*) AS merged FROM det JOIN h USING (image, d) GROUP BY image, head"
)
def merge_boxes(spark, sf_dir):
    from ..operators.selection import merge_boxes as merge

    return _round(merge(B.detections(B.lines(spark, sf_dir)), 0.2), "x0", "x1")


@query(
    "WITH d AS (SELECT doc_id, source, lang, (doc_id % 5)::INT AS fold FROM documents), s AS (SELECT fold, count(*) AS n FROM d GROUP BY fold), c AS (SELECT fold, lang, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT abs(n / sum(n) OVER (PARTITION BY fold) - sum(n) OVER (PARTITION BY lang) / sum(n) OVER ()) AS x FROM c), "
    "l AS (SELECT count(*) FILTER (f > 1) AS k FROM (SELECT source, count(DISTINCT fold) AS f FROM d GROUP BY source)) SELECT (SELECT count(*) FROM s) AS folds, (SELECT max(n) - min(n) FROM s) AS size_difference, (SELECT round(max(x), 6) FROM p) AS share_delta, k AS leaking_groups, (SELECT max(n) - min(n) FROM s) <= 2 AS sizes_even, (SELECT max(x) FROM p) < 0.01 AS shares_even, k = 0 AS no_leakage FROM l"
)
def split_validation(spark, sf_dir):
    from ..operators.selection import split_checks

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 5).cast("int").alias("fold"))
    return _round(split_checks(docs, "fold", "source", "lang"), "share_delta")


@query("WITH m AS (SELECT doc_id, (doc_id % 5)::INT AS f FROM documents), r AS (SELECT doc_id, count(*) AS n, min(quality + toxic * 2) AS lo, max(quality + toxic * 2) AS hi FROM labels GROUP BY 1) SELECT count(*) FILTER (r.n IS NULL) AS missing, count(*) FILTER (m.f IS NULL) AS extra, count(*) FILTER (r.n > 1) AS repeated, count(*) FILTER (m.f IS NOT NULL AND r.n IS NOT NULL AND (lo <> f OR hi <> f)) AS wrong_fold FROM m FULL JOIN r USING (doc_id)")
def oof_integrity(spark, sf_dir):
    from ..operators.selection import integrity

    manifest = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"))
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic") * 2).cast("int").alias("fold"))
    return integrity(manifest, rows, "doc_id", "fold")


@query("SELECT source, 'f' || (replace(source, 'src', '')::INT % 4) AS family, count(*) AS n FROM documents GROUP BY ALL")
def source_families(spark, sf_dir):
    from ..operators.selection import tag_family

    families = {f"src{i}": f"f{i % 4}" for i in range(20)}
    return tag_family(table(spark, sf_dir, "documents").select("source"), families).groupBy("source", "family").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS lang_x, n_chars, quality, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lang_y FROM documents JOIN labels USING (doc_id)")
def suffixed_join(spark, sf_dir):
    from ..operators.selection import suffixed_join as joined

    right = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("lang"))
    return joined(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), right, "doc_id")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_join_once(spark, sf_dir):
    from ..operators.selection import left_join_once as join

    right = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), right, "o_custkey")


@query("SELECT count(*) AS boxes, round(avg(l_discount), 6) AS score_mean, round(median(l_discount), 6) AS score_median, min(l_discount) AS score_min, round(quantile_cont(l_discount, 0.1), 6) AS score_q10, round(median(l_quantity * 10), 6) AS area_median, round(quantile_cont(l_quantity * 10, 0.1), 6) AS area_q10 FROM lineitem")
def prediction_statistics(spark, sf_dir):
    from ..operators import probability_maps

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_quantity") * 10).alias("area"))
    out = probability_maps.prediction_statistics(rows)
    return _round(out, *(c for c in out.columns if c != "boxes"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (0.75::DOUBLE * z[1] + 0.25::DOUBLE * z[2])::FLOAT::DOUBLE)), 4) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def model_ensemble(spark, sf_dir):
    from ..operators import probability_maps

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = v.join(other, "vec_id").select("vec_id", probability_maps.ensemble(F.col("embedding"), F.col("other"), 0.75).alias("m"))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    "WITH b AS (SELECT o_orderkey, 100 + o_custkey % 900 AS w, 100 + o_orderkey % 700 AS h FROM orders), c AS (SELECT *, trunc(w * 640 / greatest(w, h)) AS cw, trunc(h * 640 / greatest(w, h)) AS ch FROM b) SELECT o_orderkey, floor((640 - cw) / 2)::DOUBLE AS x, floor((640 - ch) / 2)::DOUBLE AS y, cw AS w, ch AS h, w / cw AS sx, -floor((640 - ch) / 2) * (h / ch) + 0.0::DOUBLE AS ty FROM c"
)
def crop_and_inverse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (100 + F.col("o_custkey") % 900).cast("double").alias("w"), (100 + F.col("o_orderkey") % 700).cast("double").alias("h"))
    out = rows.select("o_orderkey", G.crop_box(F.col("w"), F.col("h"), 640).alias("c"), G.inverse_matrix(F.col("w"), F.col("h"), 640).alias("m"))
    return out.select("o_orderkey", "c.x", "c.y", "c.w", "c.h", F.col("m")[0].alias("sx"), (F.col("m")[5] + 0.0).alias("ty"))


@query()
def image_features(spark, sf_dir):
    """Vectors as 8 x 8 gray images."""
    from ..operators import images

    pixels = F.aggregate("embedding", F.lit(""), lambda s, x: F.concat(s, F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), (128 + 256 * x).cast("int")))), 2, "0")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(pixels).alias("pixels"))
    return images.describe(rows, "vec_id")


@query()
def map_boxes(spark, sf_dir):
    """Vectors as 8 x 8 probability maps, enlarged by repetition, to boxes."""
    from ..operators import probability_maps

    big = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: (0.5 + 2 * F.element_at("embedding", (F.floor(y / 4) * 8 + F.floor(x / 4)).cast("int") + 1)).cast("float"))))
    rows = table(spark, sf_dir, "embeddings")
    maps = rows.select(F.col("vec_id").alias("image"), F.lit(32).alias("height"), F.lit(32).alias("width"), big.alias("values"))
    return probability_maps.detect(maps, probability_maps.Settings(threshold=0.6, box_threshold=0.6))


@query(
    f"WITH {B.sides()}, {B.related()} SELECT image, 'one-to-one' AS relation, g::VARCHAR AS gt_ids, d::VARCHAR AS det_ids FROM r WHERE o2o UNION ALL SELECT image, 'one-to-many', g::VARCHAR, string_agg(d::VARCHAR, ',' ORDER BY d) FROM r WHERE o2m GROUP BY image, g "
    "UNION ALL SELECT image, 'many-to-one', string_agg(g::VARCHAR, ',' ORDER BY g), d::VARCHAR FROM r WHERE m2o GROUP BY image, d"
)
def match_results(spark, sf_dir):
    related = cleval.with_relations(cleval.box_pairs(*_sides(spark, sf_dir)))
    names = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return cleval.match_results(related).select("image", "relation", names("gt_ids"), names("det_ids"))


@query("SELECT '{\"rows\":' || count(*) || ',\"customers\":' || count(DISTINCT o_custkey) || ',\"passed\":' || CASE WHEN count(*) > 1000 THEN 'true' ELSE 'false' END || '}' AS json FROM orders")
def report_json(spark, sf_dir):
    row = table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"))
    return sinks.report_json(row.withColumn("passed", F.col("rows") > 1000))
