"""Every stage of the pipeline on odd and empty tables, and on columns whose names clash with inner ones."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import quality, secret_scan, simhash, toxicity  # noqa: E402

from .test_llm_operators import SCHEMA, odd_rows  # noqa: E402

CLASHING = ["__text", "__key", "__clean", "fp", "label", "head", "th", "row_number"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd_rows()
    odd, empty = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    out = stage(spark, odd, sf_dir).collect()
    assert stage(spark, empty, sf_dir).count() == 0
    if name == "packing":
        assert Counter(r.doc_id for r in out if not r.start) == Counter(r[0] for r in rows)
    elif name == "secret_scans":
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        assert {(r.doc_id, r.text is None) for r in out} == {(r[0], r[1] is None) for r in rows}
    else:
        assert not Counter(map(str, map(tuple, out))) - Counter(map(str, map(tuple, odd.collect())))
    if name == "near_dedup":
        assert len({r.text or "" for r in out}) == len(out)
    if name == "quality_rules":
        assert all(len((r.text or "").split()) >= 50 for r in out)
    if name == "toxicity":
        assert {r.doc_id for r in out if not r.text} == {r[0] for r in rows if not r[1]}


def test_clashing_names(spark):
    rows = [(i, f"word{i} " * 60 if i else None, *(f"{c}{i}" for c in CLASHING)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    none = quality.Field(*(__import__("numpy").zeros(s) for s in ((quality.N_FEATURES, 2), (2, 2))))
    for out in (
        quality.keep_quality(df, none),
        toxicity.keep_civil(df, toxicity.Model({}, (5.0, 6.0, 7.0))),
        simhash.drop_near_duplicates(df),
        simhash.drop_near_duplicates(df, shingle_words=5, overlap=True),
        secret_scan.redact_secrets(df),
    ):
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(rows)
    assert len(got) == len(rows)
