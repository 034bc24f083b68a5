"""Sizes of the registered resamples and samples."""

from plumbline.operators import compare
from plumbline.plans import catalog


def test_bootstrap_keeps_the_operator_s_resamples(spark, sf_dir, monkeypatch):
    seen, means = {}, compare.bootstrap_means

    def spy(*args, **named):
        seen.update(named)
        return means(*args, **named)

    monkeypatch.setattr(compare, "bootstrap_means", spy)
    catalog.queries()["paired_bootstrap"](spark, sf_dir)
    assert seen.get("resamples", 10_000) == 10_000


def test_family_sample_has_as_many_draws_as_documents(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog.queries()["weighted_family_sample"](spark, sf_dir).count() == n
