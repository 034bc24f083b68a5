"""Column and row selection, validated joins, pseudo-label filters, box merging, split integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .split import components
from .validate import expect_unique


def with_prefix(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *(c for c in df.columns if c.startswith(prefix) and c not in keep))


def left_join_once(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """A left join that can't multiply rows; a repeated key on the right is an error."""
    if check:
        expect_unique(right, key)
    return left.join(right, key, "left")


def suffixed_join(left: DataFrame, right: DataFrame, key: str, suffixes=("_x", "_y")) -> DataFrame:
    """An inner join that renames what both sides have."""
    both = (set(left.columns) & set(right.columns)) - {key}
    rename = lambda df, s: df.select(*(F.col(c).alias(c + s) if c in both else F.col(c) for c in df.columns))
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), key)


def tag_family(df: DataFrame, families: dict[str, str], source: str = "source") -> DataFrame:
    """family of each row's source by a literal map; an unknown source is an error when it is read."""
    table = F.create_map(*(F.lit(x) for pair in families.items() for x in pair))
    got = F.element_at(table, F.col(source))
    return df.withColumn("family", F.when(got.isNotNull(), got).otherwise(F.raise_error(F.lit("a source without a family"))))


def pseudo_labels(boxes: DataFrame, score: str, least_score: float, least_width: float, most: int) -> DataFrame:
    """Confident boxes of enough size, equal ones once, of images that have no more than most of them."""
    kept = boxes.where((F.col(score) >= least_score) & (F.col("x1") - F.col("x0") >= least_width))
    once = kept.dropDuplicates(["image", "x0", "y0", "x1", "y1"])
    return once.withColumn("__n", F.count("*").over(W.partitionBy("image"))).where(F.col("__n") <= most).drop("__n")


def merge_boxes(boxes: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """One box for each group of boxes of an image that overlap in a chain: their hull, and how many.

    boxes: image, d, x0, y0, x1, y1. Groups are components over pairs, so chains of any length join.
    """
    box = lambda p: F.struct(*(F.col(f"{p}.{c}") for c in ("x0", "y0", "x1", "y1")))
    a, b = boxes.alias("a"), boxes.alias("b")
    near = (F.col("a.image") == F.col("b.image")) & (F.col("a.d") < F.col("b.d")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    key = lambda p: F.struct(F.col(f"{p}.image").alias("image"), F.col(f"{p}.d").alias("d"))
    pairs = a.join(b, near).where(G.box_iou(box("a"), box("b")) >= least_iou).select(key("a").alias("left"), key("b").alias("right"))
    labels = components(pairs).select(F.col("node.image").alias("image"), F.col("node.d").alias("d"), F.col("label.d").alias("head"))
    grouped = boxes.join(labels, ["image", "d"], "left").withColumn("head", F.coalesce("head", "d"))
    return grouped.groupBy("image", "head").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("merged"))


def split_checks(df: DataFrame, fold: str, group: str, stratum: str, size_slack: int = 2, share_slack: float = 0.01) -> DataFrame:
    """One row of facts and booleans on a fold assignment: sizes, shares of strata, leaking groups."""
    sizes = df.groupBy(fold).agg(F.count("*").alias("n"))
    size = sizes.agg(F.count("*").alias("folds"), F.max("n").alias("most"), F.min("n").alias("least"))
    counts = df.groupBy(fold, stratum).agg(F.count("*").alias("n"))
    in_fold = F.col("n") / F.sum("n").over(W.partitionBy(fold))
    overall = F.sum("n").over(W.partitionBy(stratum)) / F.sum("n").over(W.partitionBy())
    share = counts.select(F.abs(in_fold - overall).alias("d")).agg(F.max("d").alias("share_delta"))
    leaks = df.groupBy(group).agg(F.count_distinct(fold).alias("f")).agg(F.count_if(F.col("f") > 1).alias("leaking_groups"))
    row = size.join(share).join(leaks)
    return row.select("folds", (F.col("most") - F.col("least")).alias("size_difference"), "share_delta", "leaking_groups", (F.col("most") - F.col("least") <= size_slack).alias("sizes_even"), (F.col("share_delta") < share_slack).alias("shares_even"), (F.col("leaking_groups") == 0).alias("no_leakage"))


def split_report(df: DataFrame, key: str, fold: str, group: str, stratum: str, source: Column, features: list[str], pairs: DataFrame, rows: int, folds: int) -> DataFrame:
    """The nine checks of a fold assignment as booleans, and passed: all of them.

    source says which rows come from the split whose counts have to be even; pairs (left, right) are keys
    that have to share a fold.
    """
    size = df.groupBy(fold).agg(F.count("*").alias("n"), F.count_if(source).alias("s")).agg(F.count("*").alias("folds"), (F.max("n") - F.min("n")).alias("d"), F.when(F.count("*") < folds, F.max("s")).otherwise(F.max("s") - F.min("s")).alias("ds"))
    keys = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    leaks = df.groupBy(group).agg(F.count_distinct(fold).alias("f")).agg(F.count_if(F.col("f") > 1).alias("leaks"))
    at = df.select(F.col(key).alias("left"), F.col(fold).alias("__l"))
    torn = pairs.join(at, "left").join(at.select(F.col("left").alias("right"), F.col("__l").alias("__r")), "right").agg(F.count_if(F.col("__l") != F.col("__r")).alias("torn"))
    means = df.groupBy(fold).agg(*(F.avg(c).alias(c) for c in features))
    whole = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features))
    z = means.join(F.broadcast(whole)).agg(F.max(F.greatest(*(F.when(F.col(f"s_{c}") > 0, F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in features), F.lit(0.0))).alias("z"))
    share = split_checks(df, fold, group, stratum).select("share_delta")
    row = size.join(keys).join(leaks).join(torn).join(z).join(share)
    checks = {
        "expected_rows": F.col("rows") == rows, "unique_keys": F.col("keys") == F.col("rows"), "all_folds": F.col("folds") == folds, "sizes_even": F.col("d") <= 2, "no_group_leakage": F.col("leaks") == 0,
        "no_pair_leakage": F.col("torn") == 0, "source_even": F.col("ds") <= 2, "means_close": F.col("z") < 0.15, "shares_close": F.col("share_delta") < 0.01,
    }
    out = row.select(*(c.alias(n) for n, c in checks.items()))
    return out.withColumn("passed", F.expr(" and ".join(checks)))


def integrity(manifest: DataFrame, rows: DataFrame, key: str, fold: str) -> DataFrame:
    """Of predictions against a fold manifest: missing, extra and repeated keys, and wrong folds."""
    m = manifest.select(key, F.col(fold).alias("__f"), F.lit(True).alias("__m"))
    counted = rows.groupBy(key).agg(F.count("*").alias("__n"), F.min(fold).alias("__lo"), F.max(fold).alias("__hi"))
    j = m.join(counted, key, "full")
    wrong: Column = F.col("__m").isNotNull() & F.col("__n").isNotNull() & ((F.col("__lo") != F.col("__f")) | (F.col("__hi") != F.col("__f")))
    return j.agg(F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__m").isNull()).alias("extra"), F.count_if(F.col("__n") > 1).alias("repeated"), F.count_if(wrong).alias("wrong_fold"))


def counter_diagnosis(totals: DataFrame, method: str, control, candidate, counters: list[str]) -> DataFrame:
    """(counter, control, candidate, delta) of two methods' summed counters."""
    long = totals.select(method, *(F.col(c).cast("double").alias(c) for c in counters)).unpivot([method], counters, "counter", "value")
    pick = lambda v: F.max(F.when(F.col(method) == v, F.col("value")))
    out = long.groupBy("counter").agg(pick(control).alias("control"), pick(candidate).alias("candidate"))
    return out.withColumn("delta", F.col("candidate") - F.col("control"))
