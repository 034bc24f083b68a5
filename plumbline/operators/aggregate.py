"""Group profiles, cross tables, balance and stability summaries, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from .ranking import quantiles as exact_quantiles


def profile(df: DataFrame, by: str, metrics: list[str], quantiles=((0.5, "median"), (0.1, "q10"), (0.9, "q90"))) -> DataFrame:
    """Rows and exact quantiles of each metric of each group, all metrics in one pass; NaN counts as missing."""
    out = df.groupBy(by).agg(F.count("*").alias("rows"))
    clean = df.select(by, *(nan_to_null(F.col(m).cast("double")).alias(m) for m in metrics))
    each = quantiles_of(clean, [by], metrics, [q for q, _ in quantiles])
    out = _joined(out, each, [by])
    return out.select(by, "rows", *(F.col(f"__q_{m}")[i].alias(f"{m}_{name}") for m in metrics for i, (_, name) in enumerate(quantiles)))


def quantiles_of(df: DataFrame, by: list[str], columns: list[str], at: list[float]) -> DataFrame:
    """by and __q_x, the exact quantiles of each column; columns are sorted side by side, as groups of one table."""
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([F.col(k) for k in by], columns, "__column", "__value")
    found = exact_quantiles(long, [*by, "__column"], "__value", at, "__q")
    return found.groupBy(*by).agg(*(F.first(F.when(F.col("__column") == c, F.col("__q")), ignorenulls=True).alias(f"__q_{c}") for c in columns))


def _joined(groups: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """groups with the values of their keys, null keys too; groups without values stay."""
    right = values.withColumnsRenamed({k: f"__of_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return groups.join(right, same, "left").drop(*(f"__of_{k}" for k in by))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    c = F.col(value)
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(c).alias("mean"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"))
    return _joined(out, exact_quantiles(df, by, value, [0.5], "__q"), by).withColumn("median", F.col("__q")[0]).drop("__q")


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each group and their share of all rows."""
    from pyspark.sql import Window as W

    return df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all combinations of the values of two small dimensions, 0 where there is no row.

    Both dimensions are grouped first; their values, not the rows, are combined.
    """
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    values = counts.select(F.collect_set(a).alias("a"), F.collect_set(b).alias("b"))
    dense = values.select(F.explode("a").alias(a), "b").select(a, F.explode("b").alias(b))
    return dense.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dense_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """Counts of groups 0..n-1, missing ones as 0."""
    return df.sparkSession.range(n).select(F.col("id").cast(df.schema[by].dataType).alias(by)).join(df.groupBy(by).agg(F.count("*").alias("n")), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stability(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and most of each metric over the rows (folds)."""
    long = df.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


def balance(df: DataFrame, fold: str, features: list[str]) -> DataFrame:
    """Of each feature, the largest distance of a fold's mean from the mean, in population deviations."""
    long = df.select(fold, *(F.col(f).cast("double").alias(f) for f in features)).unpivot([fold], features, "feature", "value")
    per = long.groupBy("feature", fold).agg(F.avg("value").alias("m"))
    every = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = F.when(F.col("std") > 0, F.abs(F.col("m") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return per.join(every, "feature").groupBy("feature").agg(F.max(z).alias("max_z"))


def fold_summary(df: DataFrame, fold: str, group: str, total: str, features: list[str]) -> DataFrame:
    return df.groupBy(fold).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.sum(total).alias("total"), *(F.avg(f).alias(f"mean_{f}") for f in features))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(*map(F.col, keys))).alias("duplicates"))


def strata(df: DataFrame, named: dict[str, Column], aggregates: list[Column], by: dict[str, str] | None = None) -> DataFrame:
    """One row for each named condition that some row meets, and for each value of the columns of by, named by its prefix and the value.

    Rows may be in several strata. One pass by grouping sets, summed where the rows are.
    """
    flags = {f"__f{i}": c for i, c in enumerate(named.values())}
    groups = {f"__g{i}": F.coalesce(F.col(c).cast("string"), F.lit("null")) for i, c in enumerate((by or {}).values())}
    marked = df.withColumns(flags | groups)
    keys = [*flags, *groups]
    of_flag = [F.when((F.grouping(f) == 0) & F.col(f), F.lit(n)) for f, n in zip(flags, named, strict=True)]
    of_group = [F.when(F.grouping(g) == 0, F.concat(F.lit(prefix), F.col(g))) for g, prefix in zip(groups, by or {}, strict=True)]
    out = marked.groupingSets([[F.col(k)] for k in keys], *map(F.col, keys)).agg(F.coalesce(*of_flag, *of_group, F.lit(None).cast("string")).alias("stratum"), *aggregates)
    return out.drop(*keys).where("stratum is not null")


def quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Exact lower and upper quartiles, all columns in one pass; a handful of numbers comes to the driver."""
    row = quantiles_of(df, [], columns, [0.25, 0.75]).first()
    return {c: tuple(row[f"__q_{c}"]) if row and row[f"__q_{c}"] else (None, None) for c in columns}


def sanity(boxes: DataFrame, width: Column, height: Column, most: int = 500) -> DataFrame:
    """Counts over predicted polygons: boxes has image and polygon (array of x, y structs)."""
    out = F.exists("polygon", lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] >= width) | (p["y"] >= height))
    per = boxes.select("image", F.size("polygon").alias("points"), out.alias("out")).groupBy("image").agg(
        F.count("*").alias("polygons"), F.min("points").alias("least_points"), F.count_if(F.col("points") < 4).alias("short"), F.count_if("out").alias("out")
    )
    return per.agg(
        F.count("*").alias("images"), F.sum("polygons").alias("polygons"), F.min("least_points").alias("least_points"), F.sum("short").alias("short_polygons"),
        F.sum("out").alias("out_polygons"), F.count_if(F.col("out") > 0).alias("out_images"), F.count_if(F.col("polygons") > most).alias("full_images"), F.max("polygons").alias("most_polygons"),
    )
