"""Boxes of the test tables: an order is an image, its lines are ground truth and shifted detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores before they grow: a narrow table is often one row group, which one task reads."""
    return rows.select(*keys).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def stretch(*parts) -> Column:
    """An array of values, each repeated: (value, times)."""
    return F.concat(*(F.array_repeat(value, F.lit(times).cast("int") if isinstance(times, int) else times.cast("int")) for value, times in parts))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, k, ...): k numbers the lines of an order; line numbers repeat, so more columns order it."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    picked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return picked.withColumn("k", F.row_number().over(order).cast("long")).withColumnRenamed("l_orderkey", "image")


def ground_truth(rows: DataFrame, dont_care=None) -> DataFrame:
    x0 = 25.0 * F.col("k")
    dc = F.lit(False) if dont_care is None else dont_care
    return rows.select("image", F.col("k").alias("g"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), dc.alias("dc"))


def detections(rows: DataFrame, *more: str) -> DataFrame:
    x0 = 25.0 * F.col("k") + 100.0 * F.col("l_discount")
    return rows.select("image", F.col("k").alias("d"), x0.alias("x0"), (x0 + (F.col("l_quantity") + 100.0 * F.col("l_tax"))).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), *more)


LINES = """li AS (
  SELECT l_orderkey AS image, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k
  FROM lineitem)"""


def sides(dont_care: str = "false", keys: str = "image", thresholds: str = "") -> str:
    """CTEs gt and det; with thresholds each side carries the threshold as a part of its key."""
    t = "threshold, " if thresholds else ""
    cross = f" CROSS JOIN (SELECT unnest([{thresholds}]) AS threshold)" if thresholds else ""
    where = " WHERE l_discount >= threshold" if thresholds else ""
    return f"""{LINES},
gt AS (SELECT {t}image, k AS g, 25.0::DOUBLE * k AS x0, 25.0::DOUBLE * k + l_quantity AS x1, 0.0::DOUBLE AS y0, 10.0::DOUBLE AS y1, {dont_care} AS dc FROM li{cross}),
det AS (SELECT {t}image, k AS d, 25.0::DOUBLE * k + 100.0::DOUBLE * l_discount AS x0,
  (25.0::DOUBLE * k + 100.0::DOUBLE * l_discount) + (l_quantity + 100.0::DOUBLE * l_tax) AS x1, 0.0::DOUBLE AS y0, 10.0::DOUBLE AS y1 FROM li{cross}{where})"""


EPS = "1.1920928955078125e-07::DOUBLE"


#: CTE lost: what ground truth covers of a don't-care region in a detection (boxes of one height: lengths of unions of intervals).
LOST = """li0 AS (SELECT a.image, a.g, b.d, greatest(trunc(a.x0), trunc(c.x0), trunc(b.x0)) AS lo, least(trunc(a.x1), trunc(c.x1), trunc(b.x1)) AS hi
  FROM gt a JOIN gt c ON a.image = c.image AND a.dc AND NOT c.dc JOIN det b ON b.image = a.image),
li1 AS (SELECT *, max(hi) OVER (PARTITION BY image, g, d ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM li0 WHERE lo < hi),
lost AS (SELECT image, g, d, 10 * sum(greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS lost FROM li1 GROUP BY ALL),
"""


def related(key: str = "image", lost: bool = False) -> str:
    """CTEs from gt and det to the related pairs r and the hits h; with lost, don't-care areas are without ground truth."""
    minus, without = (LOST, "p0l AS (SELECT * REPLACE (both_area - coalesce(lost, 0) AS both_area) FROM p0 LEFT JOIN lost USING (image, g, d)),") if lost else ("", "")
    return minus + _related(key, without, "p0l" if lost else "p0")


def _related(key: str, without: str, pairs: str) -> str:
    return f"""gl AS (SELECT *, least(round_even(0.5::DOUBLE + greatest(ar, 1.0::DOUBLE / (ar + {EPS})), 0), 100)::INT AS len
  FROM (SELECT *, least(100.0::DOUBLE, (y1 - y0) / ((x1 - x0) + {EPS})) AS ar FROM gt)),
dl AS (SELECT *, least(round_even(0.5::DOUBLE + 1.0::DOUBLE / ({EPS} + ar), 0), 100)::INT AS fp_len
  FROM (SELECT *, least(100.0::DOUBLE, (y1 - y0) / ((x1 - x0) + {EPS})) AS ar FROM det)),
c0 AS (SELECT {key}, g, x0, x1, len, unnest(range(0, len)) AS c FROM gl),
c1 AS (SELECT {key}, g, c, CASE WHEN c = 0 THEN x0 ELSE trunc(x0 + (x1 - x0) / len * c) END AS xa,
  CASE WHEN c + 1 = len THEN x1 ELSE trunc(x0 + (x1 - x0) / len * (c + 1)) END AS xb FROM c0),
pcc AS (SELECT {key}, g, c, (xa + xb + xa + xb) / 4 AS cx, 5.0::DOUBLE AS cy FROM c1),
p0 AS (SELECT {key}, g, d, gl.dc,
  greatest(least(trunc(gl.x1), trunc(dl.x1)) - greatest(trunc(gl.x0), trunc(dl.x0)), 0) * greatest(least(trunc(gl.y1), trunc(dl.y1)) - greatest(trunc(gl.y0), trunc(dl.y0)), 0) AS both_area,
  (trunc(dl.x1) - trunc(dl.x0)) * (trunc(dl.y1) - trunc(dl.y0)) AS det_area, trunc(dl.x0) AS dx0, trunc(dl.x1) AS dx1
  FROM gl JOIN dl USING ({key})),
{without}
h AS (SELECT {key}, g, d, c FROM p0 JOIN pcc USING ({key}, g) WHERE cx >= dx0 AND cx < dx1 AND cy >= 0 AND cy < 10),
hn AS (SELECT {key}, g, d, count(*) AS n FROM h GROUP BY ALL),
p1 AS (SELECT {key}, g, d, dc, CASE WHEN det_area > 0 THEN both_area / det_area ELSE 0 END AS ap, coalesce(n, 0) AS n FROM {pairs} LEFT JOIN hn USING ({key}, g, d)),
p2 AS (SELECT *, (ap::FLOAT >= 0.3::FLOAT AND n > 0) AS s,
  (max((dc AND ap::FLOAT >= 0.3::FLOAT)::INT) OVER (PARTITION BY {key}, d) > 0
    OR sum(CASE WHEN dc AND n > 0 THEN ap ELSE 0 END) OVER (PARTITION BY {key}, d) >= 0.3::DOUBLE) AS det_dc FROM p1),
p3 AS (SELECT *, (NOT dc AND NOT det_dc) AS v FROM p2),
p4 AS (SELECT *, sum(s::INT) OVER (PARTITION BY {key}, g) AS sg, sum(s::INT) OVER (PARTITION BY {key}, d) AS sd,
  sum((s AND v)::INT) OVER (PARTITION BY {key}, g) AS sgv, sum((n > 0 AND v)::INT) OVER (PARTITION BY {key}, d) AS nv,
  sum(CASE WHEN n > 0 AND v THEN ap ELSE 0 END) OVER (PARTITION BY {key}, d) AS apv FROM p3),
r AS (SELECT *, (v AND s AND sg = 1 AND sd = 1) AS o2o, (v AND s AND sgv >= 2) AS o2m, (n > 0 AND v AND nv >= 2 AND apv >= 0.3::DOUBLE) AS m2o FROM p4)"""


def counted(key: str = "image") -> str:
    """CTE per: counters and scores of each image."""
    return f"""mt AS (SELECT * FROM r WHERE o2o OR o2m OR m2o),
mh AS (SELECT {key}, g, d, c FROM h SEMI JOIN mt USING ({key}, g, d)),
tpc AS (SELECT {key}, count(DISTINCT (g, c)) AS tp, count(*) AS hits FROM mh GROUP BY ALL),
bg AS (SELECT {key}, sum(m - 1) AS eg, sum((m > 1)::INT) AS ns FROM (SELECT {key}, g, count(*) AS m FROM mt GROUP BY ALL) GROUP BY ALL),
bd AS (SELECT {key}, sum(m - 1) AS ed, sum((m > 1)::INT) AS nm FROM (SELECT {key}, d, count(*) AS m FROM mt GROUP BY ALL) GROUP BY ALL),
fpc AS (SELECT {key}, sum(fp_len) AS fp FROM dl ANTI JOIN (SELECT {key}, d FROM mt UNION SELECT {key}, d FROM r WHERE det_dc) x USING ({key}, d) GROUP BY ALL),
ch AS (SELECT {key}, sum(CASE WHEN dc THEN 0 ELSE len END) AS n_gt FROM gl GROUP BY ALL),
im AS (SELECT {key} FROM gl UNION SELECT {key} FROM dl),
k0 AS (SELECT {key}, coalesce(n_gt, 0)::BIGINT AS n_gt, coalesce(tp, 0)::BIGINT AS tp, (coalesce(hits, 0) - coalesce(tp, 0))::BIGINT AS overlapped, coalesce(fp, 0)::BIGINT AS fp,
  coalesce(eg, 0)::DOUBLE AS gran_recall, coalesce(ed, 0)::DOUBLE AS gran_precision, coalesce(ns, 0)::BIGINT AS n_split, coalesce(nm, 0)::BIGINT AS n_merged
  FROM im LEFT JOIN ch USING ({key}) LEFT JOIN tpc USING ({key}) LEFT JOIN bg USING ({key}) LEFT JOIN bd USING ({key}) LEFT JOIN fpc USING ({key})),
k1 AS (SELECT *, (tp + overlapped + fp)::BIGINT AS n_det FROM k0),
per AS ({scored('k1')})"""


def scored(source: str) -> str:
    return f"""SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2.0::DOUBLE * recall * precision / (recall + precision) END AS hmean FROM (
  SELECT *, CASE WHEN n_gt > 0 THEN greatest(0, tp - gran_recall) / n_gt ELSE 0 END AS recall,
    CASE WHEN n_det > 0 THEN greatest(0, tp - gran_precision) / n_det ELSE 0 END AS precision FROM {source})"""


COUNTER_SUMS = "sum(n_gt)::BIGINT AS n_gt, sum(n_det)::BIGINT AS n_det, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(overlapped)::BIGINT AS overlapped, sum(gran_recall) AS gran_recall, sum(gran_precision) AS gran_precision, sum(n_split)::BIGINT AS n_split, sum(n_merged)::BIGINT AS n_merged"
