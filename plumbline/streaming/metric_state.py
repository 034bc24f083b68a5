"""Running global scores over a stream of per-image counters: sums merge, so a streaming aggregate does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleval import COUNTERS, with_scores


def running_scores(counters: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Scores of each window; rows later than the watermark are left out."""
    sums = counters.withWatermark(time, late).groupBy(F.window(time, window)).agg(*(F.sum(c).alias(c) for c in COUNTERS))
    return with_scores(sums)
