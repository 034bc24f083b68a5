"""Contracts, submission validators and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import all_finite


class ContractError(ValueError):
    """A table breaks what an operator was promised."""


def expect_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def expect_unique(df: DataFrame, *keys: str) -> DataFrame:
    row = df.groupBy(*keys).count().where("count > 1").first()
    if row:
        raise ContractError(f"not unique: {[row[k] for k in keys]}")
    return df


def expect_no_nulls(df: DataFrame, *names: str) -> DataFrame:
    row = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first()
    if bad := [n for n in names if row[n]]:
        raise ContractError(f"nulls in: {', '.join(bad)}")
    return df


def contract_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A one-to-one full join; a row without its partner or a repeated key is an error."""
    expect_unique(left, *keys)
    expect_unique(right, *keys)
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full")
    if joined.where("__l is null or __r is null").first():
        raise ContractError("rows without a partner")
    return joined.drop("__l", "__r")


def join_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys in both tables, in the left one only and in the right one only."""
    l, r = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return l.join(r, keys, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Numbers of missing and extra keys."""
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").agg(F.count("*").alias("extra"))
    return missing.join(extra)


def leakage(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).agg(F.count("*").alias("groups"), F.count_if(F.col("folds") > 1).alias("leaking"))


FATAL = ("short_polygons", "bad_numbers", "zero_area", "invalid_geometry", "duplicate_polygons", "far_outside", "full_images")


def polygon_checks(boxes: DataFrame, width: Column, height: Column, tolerance: float = 8.0, most: int = 500) -> DataFrame:
    """Counters over the polygons of a submission.

    boxes: image and polygon. A polygon is short under 4 points, bad with a null, NaN or infinite
    coordinate, and a duplicate if an equal one of its image comes before it; such duplicates are the
    rows beyond the first of each distinct polygon. Polygons are sorted within their images, so equal
    ones are neighbours and no table of them is held; the sort spills where a task has little memory.
    """
    in_order = W.partitionBy("image").orderBy("polygon")
    placed = boxes.select("image", "polygon", width.alias("width"), height.alias("height")).select("*", F.row_number().over(in_order).alias("k"), F.lag("polygon").over(in_order).alias("before"))
    p = F.col("polygon")
    checked = placed.select(
        "k", ((F.col("k") > 1) & p.eqNullSafe(F.col("before"))).alias("again"), (F.size(p) < 4).alias("short"), (~all_finite(G.flatten_polygon(p))).alias("bad"), (G.area(p) == 0).alias("flat"),
        (self_crossing(p) & (G.area(p) != 0)).alias("crossing"), G.overshoot(p, F.col("width"), F.col("height")).alias("over"),
    )
    number = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return checked.agg(
        F.count_if(F.col("k") == 1).alias("images"), F.sum(F.lit(1)).alias("polygons"), number(F.col("short")).alias("short_polygons"), number(F.col("bad")).alias("bad_numbers"), number(F.col("flat") & ~F.col("bad")).alias("zero_area"), number(F.col("crossing")).alias("invalid_geometry"),
        number(F.col("again")).alias("duplicate_polygons"), number(~F.col("bad") & (F.col("over") > 0)).alias("outside"), number(~F.col("bad") & (F.col("over") > tolerance)).alias("far_outside"), F.count_if(F.col("k") == most + 1).alias("full_images"),
    )


def submission_report(boxes: DataFrame, expected: DataFrame, width: Column, height: Column, tolerance: float = 8.0, most: int = 500) -> DataFrame:
    """polygon_checks() and the counters that need the expected images: missing, extra and empty ones, and polygons per image.

    boxes: image and polygon, a row with a null polygon for an image without any; expected: image, once or more. An
    expected image without a row is missing, one with only a null polygon empty.
    """
    sent = boxes.select("image", F.col("polygon").isNotNull().cast("long").alias("n"), F.lit(False).alias("asked"))
    asked = expected.select("image", F.lit(None).cast("long").alias("n"), F.lit(True).alias("asked"))
    unnamed = (F.col("image").isNull() & F.col("asked")).alias("unnamed")  # an image without a name meets no other one
    met = sent.unionByName(asked).groupBy("image", unnamed).agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    counts = met.agg(
        F.count("n").alias("rows"), F.count_if(F.col("n").isNull()).alias("missing_images"), F.count_if(~F.col("asked")).alias("extra_images"), F.count_if(F.col("n") == 0).alias("empty_images"),
        F.coalesce(F.min("n"), F.lit(0)).alias("least_polygons"), F.coalesce(F.max("n"), F.lit(0)).alias("most_polygons"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_polygons"),
    )
    checks = polygon_checks(boxes.where(F.col("polygon").isNotNull()), width, height, tolerance, most).drop("images")
    return passed(counts.join(checks), (*FATAL, "missing_images", "extra_images"))


def same_settings(left: dict[str, float], right: dict[str, float]) -> None:
    """Two models whose maps are mixed have to be binarised alike."""
    if bad := sorted(k for k in left.keys() | right.keys() if left.get(k) != right.get(k)):
        raise ContractError(f"settings differ: {', '.join(bad)}")


def passed(checks: DataFrame, fatal=FATAL) -> DataFrame:
    return checks.withColumn("passed", F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in fatal), F.lit(0)) == 0)


def self_crossing(polygon: Column) -> Column:
    """Whether a ring is no simple one: edges that are no neighbours cross, touch or overlap, or neighbours fold back on each other.

    Repeated points in a row count once. A ring of under three different points in a row is not looked at.
    """
    last = F.element_at(polygon, -1)
    ring = F.filter(polygon, lambda p, i: p != F.when(i == 0, last).otherwise(F.get(polygon, i - 1)))

    def check(p: Column) -> Column:
        n = F.size(p)
        at = lambda i: F.element_at(p, (i % n).cast("int") + 1)
        turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
        overlap = lambda a, b, c, d, k: (F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k])) <= F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])))

        def meets(i: Column, j: Column) -> Column:
            a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
            near = overlap(a, b, c, d, "x") & overlap(a, b, c, d, "y")
            apart = (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)
            return (j > i + 1) & ~((i == 0) & (j == n - 1)) & near & apart  # cheap tests first: the rest is skipped

        def folds(i: Column) -> Column:
            a, b, c = at(i), at(i + 1), at(i + 2)
            return (turn(a, b, c) == 0) & ((b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"]) < 0)

        edges = F.sequence(F.lit(0), n - 1)
        return F.when(n < 3, F.lit(False)).otherwise(F.exists(edges, lambda i: folds(i) | F.exists(edges, lambda j: meets(i, j))))

    # Bound once: a ring that stands in an expression many times is made as often.
    return F.coalesce(F.get(F.transform(F.array(ring), check), 0), F.lit(False))


def csv_checks(csv: DataFrame, expected: DataFrame) -> DataFrame:
    """Counters over a CSV submission (filename, polygons) against polygon counts (filename, n)."""
    sets = F.when(F.coalesce(F.col("polygons"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("polygons", r"\|"))
    numbers = F.transform(sets, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda v: v.try_cast("double")))
    bad = F.size(F.filter(numbers, lambda v: (F.size(v) < 8) | (F.size(v) % 2 != 0) | F.exists(v, lambda x: x.isNull())))
    infinite = F.size(F.filter(numbers, lambda v: ~all_finite(v) & F.forall(v, lambda x: x.isNotNull())))
    rows = csv.select("filename", F.size(sets).alias("k"), bad.alias("bad"), infinite.alias("infinite"))
    merged = rows.join(expected.select("filename", "n"), "filename", "full")
    return merged.agg(
        F.count("k").alias("rows"), (F.count("k") - F.count_distinct(F.when(F.col("k").isNotNull(), F.col("filename")))).alias("duplicate_rows"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("extra"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_sets"), F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite_sets"), F.count_if(F.col("k") != F.col("n")).alias("count_mismatches"),
    )


def gates(row: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One boolean a gate, and passed: all of them."""
    checked = [F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()]
    out = row.select(*checked)
    all_of = F.lit(True)
    for n in conditions:
        all_of = all_of & F.col(n)
    return out.withColumn("passed", all_of)
