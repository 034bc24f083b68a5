"""P-values against all orders of small samples; the bootstrap of scores against resamples by index."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleval, compare


def test_ks_counts_all_orders():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4)):
        stats = []
        for ones in itertools.combinations(range(n + m), n):
            a = b = worst = 0
            for k in range(n + m):
                a, b = a + (k in ones), b + (k not in ones)
                worst = max(worst, abs(a * m - b * n))
            stats.append(worst)
        for d in set(stats):
            assert compare.ks_pvalue(d / (n * m), n, m) == pytest.approx(sum(s >= d for s in stats) / len(stats), rel=1e-12)
    assert compare.ks_pvalue(1.0, 300, 200) == pytest.approx(2 / math.comb(500, 200), rel=1e-9)
    assert compare.ks_pvalue(0.05, 4000, 5000) == pytest.approx(compare.ks_pvalue(0.05, 10_001, 10_001 * 2000 // 9001) ** 1.0, rel=2)
    assert compare.ks_pvalue(0.0, 5, 5) == 1


def test_pvalues_are_columns(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=60)] + [("b", float(v)) for v in rng.normal(0.8, 1, 45)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = compare.drift(df, "g", "v", "a").first()
    assert r["ks_pvalue"] == compare.ks_exact(r["ks_statistic"], 60, 45) < 0.05
    s = compare.spearman(spark.createDataFrame([(float(i), float((i * 7) % 20)) for i in range(20)], "a double, b double"), "a", "b").first()
    assert s["pvalue"] == pytest.approx(compare.spearman_pvalue(s["rho"], 20)) and 0 < s["pvalue"] < 1
    assert compare.spearman(df.where("g = 'none'").withColumn("w", F.col("v")), "v", "w").first()["pvalue"] is None


def test_bootstrap_of_scores(spark):
    rng = np.random.default_rng(4)
    n, counters, metrics = 250, ["n_gt", "n_det", "tp", "gran_recall", "gran_precision"], ["recall", "precision", "hmean"]
    tp = rng.integers(5, 20, (n, 2))
    gt, det = tp.max(axis=1) + rng.integers(0, 5, n), tp + rng.integers(0, 6, (n, 2))
    rows = []
    for i in range(n):
        row = [i]
        for m in range(2):
            r, p = tp[i, m] / gt[i], tp[i, m] / det[i, m]
            row += [float(v) for v in (gt[i], det[i, m], tp[i, m], 0, 0, r, p, 2 * r * p / (r + p))]
        rows.append(tuple(row))
    names = ", ".join(f"{m}_{c} double" for m in ("a", "b") for c in counters + metrics)
    df = spark.createDataFrame(rows, f"image long, {names}")
    got = {r["metric"]: r for r in compare.bootstrap_scores(df, "image", ("a", "b"), counters, metrics, cleval.with_scores, resamples=2000).collect()}
    assert set(got) == {f"{k}_{x}" for k in ("macro", "global") for x in metrics}
    x = np.array(rows)
    at = rng.integers(0, n, (2000, n))
    score = lambda s, o: (s[:, o + 3] / s[:, o + 1], s[:, o + 3] / s[:, o + 2])
    sums = x[at].sum(axis=1)
    for k, name in enumerate(("recall", "precision")):
        d = score(sums, 8)[k] - score(sums, 0)[k]
        r = got[f"global_{name}"]
        assert (r["delta_mean"], r["ci95_low"], r["ci95_high"]) == pytest.approx((d.mean(), *np.quantile(d, [0.025, 0.975])), abs=0.2 * d.std() + 1e-6)
        m = (x[:, 14 + k] - x[:, 6 + k])[at].mean(axis=1)
        r = got[f"macro_{name}"]
        assert (r["delta_mean"], r["ci95_low"], r["ci95_high"]) == pytest.approx((m.mean(), *np.quantile(m, [0.025, 0.975])), abs=0.2 * m.std() + 1e-6)


def test_drawn_indices(spark):
    """Every resample draws n rows by the formula, and the plan doesn't grow with n."""
    got = [tuple(r) for r in compare.drawn_indices(spark, 3, 7).collect()]
    assert sorted(got) == sorted((r, (r * 7919 + k * 104729 + r * k * 31) % 7) for r in range(3) for k in range(7))
    catalog_plan = compare.drawn_indices(spark, 100, 100_000)._jdf.queryExecution().toString()
    assert len(catalog_plan) < 20_000
    assert compare.drawn_indices(spark, 3, 0).count() == 0


def test_poisson_weights_are_those_of_the_distribution():
    """Looked-up weights equal those that a search of the cumulated shares gives, and come in blocks."""
    import inspect

    rng = np.random.default_rng(0)
    keys, draws = rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.arange(400, dtype=np.uint64)
    h = keys[:, None] ^ draws[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ h >> np.uint64(32)) >> np.uint64(11)) / float(1 << 53)
    assert (compare.poisson_weights(keys, draws) == np.searchsorted(compare._POISSON, u, side="right")).all()
    assert "poisson_weights" in inspect.getsource(compare.resampled_sums)
