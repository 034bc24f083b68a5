"""Comparing runs: deltas, paired bootstrap, strata, drift, correlation, greedy matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from .aggregate import strata as strata_of
from .ranking import average_rank, cut_lineage, in_ranges, quantiles, shifts, with_shifts


def paired(control: DataFrame, candidate: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """control_, candidate_ and delta_ columns of each metric, joined on key."""
    a = control.select(key, *(F.col(m).alias(f"control_{m}") for m in metrics))
    b = candidate.select(key, *(F.col(m).alias(f"candidate_{m}") for m in metrics))
    return a.join(b, key).select("*", *((F.col(f"candidate_{m}") - F.col(f"control_{m}")).alias(f"delta_{m}") for m in metrics))


def win_loss(pairs: DataFrame, metric: str, tolerance: float = 1e-12) -> DataFrame:
    d = F.col(f"delta_{metric}")
    best = F.greatest(f"control_{metric}", f"candidate_{metric}")
    return pairs.agg(F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.avg(best).alias("oracle_mean"))


def resampled_sums(df: DataFrame, key: str, columns: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(resample, s0, s1, ..., n): sums of the columns and of the weights over all rows, in each Poisson resample.

    Every row draws its weight in each resample from its key: a block of rows is a matrix of weights
    times a matrix of columns, summed where the rows are. A task gives one row for each resample, so no
    table of resamples times rows is ever made.
    """
    sums = [f"s{i}" for i in range(len(columns))]

    def partial(batches):
        total = np.zeros((resamples, len(columns) + 1))
        for pdf in batches:
            x = np.column_stack([pdf[sums].to_numpy(float), np.ones(len(pdf))])
            keys = pd.util.hash_array(pdf["key"].astype(str).to_numpy(object)).astype(np.uint64)
            for a in range(0, resamples, _DRAWS[1]):
                r = np.arange(a, min(a + _DRAWS[1], resamples), dtype=np.uint64)
                for b in range(0, len(x), _DRAWS[0]):
                    total[a : a + len(r)] += poisson_weights(keys[b : b + _DRAWS[0]], r + np.uint64(seed)).T @ x[b : b + _DRAWS[0]]
        yield pd.DataFrame({"resample": np.arange(resamples), **{s: total[:, i] for i, s in enumerate(sums)}, "n": total[:, -1]})

    rows = df.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(s) for c, s in zip(columns, sums, strict=True)))
    # A row costs as many draws as there are resamples: the scan's few large parts would leave cores idle.
    dealt = rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "key")
    parts = dealt.mapInPandas(partial, ", ".join(["resample long", *(f"{s} double" for s in sums), "n double"]))
    return parts.groupBy("resample").agg(*(F.sum(s).alias(s) for s in sums), F.sum("n").alias("n"))


def bootstrap_means(df: DataFrame, key: str, values: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of means: mean, 2.5 and 97.5 % quantiles and the share above 0 of each value."""
    sums = resampled_sums(df, key, values, resamples, seed)
    return _intervals(sums.select(*((F.col(f"s{i}") / F.col("n")).alias(v) for i, v in enumerate(values))), values)


def bootstrap_scores(df: DataFrame, key: str, methods: tuple[str, str], counters: list[str], metrics: list[str], scored, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Intervals of the differences of two methods' scores, macro_ and global_ from the same draws.

    df has a row an image: key, method_counter and method_metric of both methods. macro_x is the mean of
    the images' differences; for global_x the counters of a resample are summed and scored once (scored:
    a table with the counters to one with the metrics). The second method's less the first's.
    """
    first, second = methods
    named = [f"{m}_{c}" for m in methods for c in counters]
    rows = df.select(key, *named, *((F.col(f"{second}_{x}") - F.col(f"{first}_{x}")).alias(x) for x in metrics))
    sums = resampled_sums(rows, key, [*named, *metrics], resamples, seed)
    at = {c: f"s{i}" for i, c in enumerate([*named, *metrics])}
    macro = sums.select("resample", *((F.col(at[x]) / F.col("n")).alias(f"macro_{x}") for x in metrics))
    a, b = (scored(sums.select("resample", *(F.col(at[f"{m}_{c}"]).alias(c) for c in counters))) for m in methods)
    both = a.select("resample", *(F.col(x).alias(f"a_{x}") for x in metrics)).join(b.select("resample", *metrics), "resample")
    out = both.select("resample", *((F.col(x) - F.col(f"a_{x}")).alias(f"global_{x}") for x in metrics)).join(macro, "resample")
    return _intervals(out, [f"{k}_{x}" for k in ("macro", "global") for x in metrics])


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: The least numbers of 53 bits that reach these shares, and what the first 16 of the bits say: the weight, or 255 where they don't settle it.
_REACHED = np.ceil(_POISSON[_POISSON < 1] * (1 << 53)).astype(np.uint64)
_LOW, _HIGH = (np.searchsorted(_REACHED, (np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)) + np.uint64(end), side="right") for end in (0, (1 << 37) - 1))
_WEIGHT = np.where(_LOW == _HIGH, _LOW, 255).astype(np.uint8)
#: Rows and resamples that are drawn at once: their hashes stay in a core's cache.
_DRAWS = (128, 512)


def poisson_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The Poisson weight (mean 1) of each key in each draw, as a matrix of floats."""
    h = keys[:, None] ^ (draws * np.uint64(0x9E3779B97F4A7C15))[None, :]
    t = np.empty_like(h)
    for shift, by in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        np.right_shift(h, np.uint64(shift), out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, np.uint64(by), out=h)
    w = np.take(_WEIGHT, np.right_shift(h, np.uint64(48), out=t).view(np.int64).ravel(), mode="wrap")
    open_ = np.flatnonzero(w == 255)
    v = h.ravel()[open_]
    w[open_] = np.searchsorted(_REACHED, (v ^ v >> np.uint64(32)) >> np.uint64(11), side="right")
    return w.astype(float).reshape(h.shape)


def drawn_indices(spark: SparkSession, resamples: int, n: int) -> DataFrame:
    """(resample, row): n rows of 0 to n - 1 for each resample, by a formula that SQL can repeat."""
    cells = spark.range(resamples * n)
    r, k = F.call_function("div", F.col("id"), F.lit(max(n, 1))), F.col("id") % max(n, 1)
    drawn = cells.select(r.alias("resample"), k.alias("k"))
    r, k = F.col("resample"), F.col("k")
    return drawn.select("resample", F.pmod(r * 7919 + k * 104729 + r * k * 31, F.lit(max(n, 1))).alias("row"))


def bootstrap_indexed(df: DataFrame, indices: DataFrame, value: str) -> DataFrame:
    """Intervals of the mean of value over given resamples: indices has resample and row, df has row."""
    means = indices.join(df.select("row", F.col(value).alias("x")), "row").groupBy("resample").agg(F.avg("x").alias(value))
    return _intervals(means, [value])


def bootstrap_exact(table: pd.DataFrame, values: list[str], resamples: int = 10_000, seed: int = 42, chunk: int = 500) -> pd.DataFrame:
    """Resampled means of a table that fits the driver, by numpy's generator in chunks; indices are shared over values."""
    rng = np.random.default_rng(seed)
    x, parts = table[values].to_numpy(float), []
    for a in range(0, resamples, chunk):
        parts.append(x[rng.integers(0, len(x), (min(chunk, resamples - a), len(x)))].mean(axis=1))
    m = np.concatenate(parts)
    low, high = np.quantile(m, [0.025, 0.975], axis=0)
    return pd.DataFrame({"metric": values, "delta_mean": m.mean(axis=0), "ci95_low": low, "ci95_high": high, "probability_gt_0": (m > 0).mean(axis=0)})


def bootstrap_global(df: DataFrame, indices: DataFrame, methods: tuple[str, str], counters: list[str], scored) -> DataFrame:
    """Intervals of the differences of global scores over given resamples.

    df has row and, for both methods, the counters as method_counter; indices has resample and row. The
    counters of a resample's rows are summed, then scored once (scored: a table with the counters to one
    with recall, precision and hmean), as global scores are; the second method's less the first's.
    """
    sums = indices.join(df, "row").groupBy("resample").agg(*(F.sum(f"{m}_{c}").alias(f"{m}_{c}") for m in methods for c in counters))
    sums = cut_lineage(sums)  # a row for each resample, read twice
    first, second = (scored(sums.select("resample", *(F.col(f"{m}_{c}").alias(c) for c in counters))) for m in methods)
    names = ["recall", "precision", "hmean"]
    both = first.select("resample", *(F.col(n).alias(f"a_{n}") for n in names)).join(second.select("resample", *names), "resample")
    return _intervals(both.select(*((F.col(n) - F.col(f"a_{n}")).alias(f"global_{n}") for n in names)), [f"global_{n}" for n in names])


def three_way(comparison: DataFrame, first: DataFrame, second: DataFrame, key: str, metric: str) -> DataFrame:
    """A comparison of two models with the metric of each and their difference; only keys that all three have."""
    a, b = (df.select(key, F.col(metric).alias(f"{n}_{metric}")) for n, df in (("first", first), ("second", second)))
    return comparison.join(a, key).join(b, key).withColumn(f"{metric}_delta", F.col(f"second_{metric}") - F.col(f"first_{metric}"))


def paired_strata(pairs: DataFrame, strata: dict, metrics: list[str], tolerance: float = 1e-12, by: dict[str, str] | None = None) -> DataFrame:
    """Of each stratum (conditions, which may overlap, and values of columns as for aggregate.strata()): images, means of both sides and of the difference, and how many improved or got worse by the first metric."""
    d = F.col(f"delta_{metrics[0]}")
    means = [F.avg(f"{p}_{m}").alias(f"{p}_{m}") for m in metrics for p in ("control", "candidate", "delta")]
    return strata_of(pairs, strata, [F.count("*").alias("images"), *means, F.count_if(d > tolerance).alias("improved"), F.count_if(d < -tolerance).alias("worse")], by)


def _intervals(means: DataFrame, values: list[str]) -> DataFrame:
    long = means.select(*values).unpivot([], values, "metric", "value")
    q = F.percentile("value", [0.025, 0.975])
    out = long.groupBy("metric").agg(F.avg("value").alias("delta_mean"), q.alias("q"), F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("probability_gt_0"))
    return out.select("metric", "delta_mean", F.col("q")[0].alias("ci95_low"), F.col("q")[1].alias("ci95_high"), "probability_gt_0")


def drift(df: DataFrame, group: str, value: str, reference: str) -> DataFrame:
    """KS statistic, its p-value, Wasserstein-1 distance and medians of each group against the reference.

    Values are counted first, so the sort holds distinct values; running counts come from ranges.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    base = counts.where(F.col("g") == reference).select("v", F.col("n").alias("a"))
    targets = counts.where(F.col("g") != reference).select("g").distinct()
    spread = base.join(F.broadcast(targets)).select("g", "v", "a", F.lit(0).cast("long").alias("b"))
    both = spread.unionByName(counts.where(F.col("g") != reference).select("g", "v", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    merged = both.groupBy("g", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    from pyspark.sql import Window as W

    dealt = in_ranges(cut_lineage(merged), "v", ties=False)
    inside = W.partitionBy("g", "__range").orderBy("v")
    up = inside.rowsBetween(W.unboundedPreceding, 0)
    each = dealt.select("g", "__range", "v", F.sum("a").over(up).alias("ia"), F.sum("b").over(up).alias("ib"), F.lead("v").over(inside).alias("after"))
    placed = with_shifts(each, shifts(dealt, ["g"], {"a": F.sum("a"), "b": F.sum("b")}, "v"), ["g"])
    gaps = placed.select(
        "g", "v", (F.col("ia") + F.col("__before_a")).alias("ca"), (F.col("ib") + F.col("__before_b")).alias("cb"), F.col("__all_a").alias("na"), F.col("__all_b").alias("nb"), F.coalesce("after", "__next").alias("next")
    )
    distance = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    stats = gaps.groupBy("g").agg(
        F.max(distance).alias("ks_statistic"), F.sum(distance * (F.coalesce("next", "v") - F.col("v"))).alias("wasserstein"), F.first("na").alias("n_reference"), F.first("nb").alias("n_target")
    )
    m = cut_lineage(quantiles(rows, ["g"], "v", [0.25, 0.5, 0.75], "q"))
    ref = m.where(F.col("g") == reference).select(F.col("q")[1].alias("reference_median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    out = stats.join(m.select("g", F.col("q")[1].alias("target_median")), "g").join(F.broadcast(ref))
    return out.select(
        F.col("g").alias(group), "n_reference", "n_target", "reference_median", "target_median", (F.col("target_median") - F.col("reference_median")).alias("median_delta"),
        "ks_statistic", ks_pvalue_of("ks_statistic", "n_reference", "n_target").alias("ks_pvalue"), "wasserstein", (F.col("wasserstein") / F.greatest("iqr", F.lit(1e-12))).alias("wasserstein_over_iqr"),
    )


#: Samples up to which the KS p-value counts paths.
EXACT_SAMPLES = 10_000


def ks_exact(statistic: float, n: int, m: int) -> float:
    """The share of orders of n and m values, all equally likely, whose statistic is as large: lattice paths that leave the band.

    Paths from (0, 0) to (n, m) meet on the diagonals i + j = k; the share that has left by (i, j) is a
    mean of those at (i - 1, j) and (i, j - 1), so no difference of large numbers is taken.
    """
    far = round(statistic * n * m)
    if far <= 0:
        return 1.0
    u, i = np.zeros(n + 1), np.arange(n + 1)
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(k, n)
        at = i[low : high + 1]
        before = np.concatenate(([0.0], u[:high]))[low : high + 1]
        now = (at * before + (k - at) * u[low : high + 1]) / k
        now[np.abs(at * m - (k - at) * n) >= far] = 1.0
        u[low : high + 1] = now
    return float(min(u[n], 1.0))


def ks_pvalue(statistic: float, n: int, m: int) -> float:
    """Two-sided p-value of the two-sample statistic: exact for samples up to EXACT_SAMPLES, by the asymptotic series beyond."""
    if max(n, m) <= EXACT_SAMPLES:
        return ks_exact(statistic, n, m)
    en = math.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * statistic
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def ks_pvalue_of(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue(s, int(a), int(b)) for s, a, b in zip(statistic, n, m, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def spearman_pvalue_of(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or math.isnan(r) else spearman_pvalue(r, int(k)) for r, k in zip(rho, n, strict=True)], dtype=float)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows that have both values, their number, and the two-sided p-value; null under 3 rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = average_rank(average_rank(both, "a", name="ra"), "b", name="rb")
    return ranked.agg(F.corr("ra", "rb").alias("r"), F.count("*").alias("samples")).select(F.when(F.col("samples") >= 3, F.col("r")).alias("rho"), "samples").select("rho", "samples", spearman_pvalue_of("rho", "samples").alias("pvalue"))


def spearman_pvalue(rho: float, n: int) -> float:
    """Two-sided p-value by Student's t, with the incomplete beta as a continued fraction."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return _incomplete_beta(df / 2, 0.5, df / (df + t2))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        numerator = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + numerator * d, 1e-300) if abs(1 + numerator * d) > 1e-300 else 1e300
        c = 1 + numerator / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def calibration(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation, mean absolute and root mean square error of two score columns."""
    d = F.col(a) - F.col(b)
    return df.agg(F.count("*").alias("rows"), F.corr(a, b).alias("pearson"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def threshold_sweep(det: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """det once for each threshold that its score reaches; the column threshold joins the image as a key."""
    kept = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t)
    return det.withColumn("threshold", F.explode(kept))


def iou_candidates(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """(image, i, j, iou) of boxes of two models; a, b: image, i or j, box (struct x0, y0, x1, y1)."""
    pairs = a.select("image", "i", F.col("box").alias("p")).join(b.select("image", "j", F.col("box").alias("q")), "image")
    return pairs.withColumn("iou", G.box_iou(F.col("p"), F.col("q"))).where(F.col("iou") >= least).select("image", "i", "j", "iou")


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one matches of each image: best IoU first, ties by i and then j, each side once.

    One exchange by image; the sorted rows of a task stream by, and what is remembered is an image's
    matched boxes.
    """
    rows = candidates.select("image", "i", "j", "iou")

    def match(batches):
        at, left, right = None, set(), set()
        for b in batches:
            keep = []
            for image, i, j in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if image != at:
                    at, left, right = image, set(), set()
                free = i not in left and j not in right
                keep.append(free)
                if free:
                    left.add(i)
                    right.add(j)
            yield b.filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition("image").sortWithinPartitions("image", F.desc("iou"), "i", "j")
    return ordered.mapInArrow(match, rows.schema)


def match_report(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """Per image: boxes of both models, matches, mean IoU (null if a side has no box) and Jaccard index."""
    n = a.groupBy("image").agg(F.count("*").alias("n_a")).join(b.groupBy("image").agg(F.count("*").alias("n_b")), "image", "full")
    m = matches.groupBy("image").agg(F.count("*").alias("matched"), F.avg("iou").alias("iou"))
    r = n.join(m, "image", "left").select("image", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "matched")), "iou")
    mean = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.coalesce("iou", F.lit(0.0)))
    return r.select("image", "n_a", "n_b", "matched", (F.col("n_a") - F.col("matched")).alias("only_a"), (F.col("n_b") - F.col("matched")).alias("only_b"), mean.alias("mean_iou"), (F.col("matched") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("matched"), F.lit(1))).alias("jaccard"))


