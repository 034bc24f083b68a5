"""The pipeline stage by stage against plain versions of the same decisions."""

from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import quality, secret_scan, toxicity  # noqa: E402
from plumbline.llm.common import read_table  # noqa: E402

from .test_llm_operators import brute_counts  # noqa: E402
from .test_overlap import brute_heads  # noqa: E402


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = docs.collect()
    field = quality.fit(docs, labels)
    shares = quality.content_shares(field, quality.count([r.text for r in rows]))
    rows = [r for r, s in zip(rows, shares, strict=True) if not brute_counts(r.text)[-1] and s >= quality.MIN_CONTENT_SHARE]
    model = toxicity.fit(docs, labels)
    score = model.scorer()
    civil = [r for r in rows if model.at_least(score(r.text))[0] < toxicity.THRESHOLD]
    assert len(civil) < len(rows)  # the stage has something to drop
    rows = civil
    heads = set(brute_heads([(r.doc_id, r.text) for r in rows]))  # 5-word shingles, overlap of 0.8
    want = {r.doc_id: secret_scan.redacted(r.text) for r in rows if r.doc_id in heads}
    got = defaultdict(int)
    tokens = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
        tokens[r.doc_id] = r.doc_tokens
    assert dict(got) == tokens and set(got) == set(want)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
        at = spark.createDataFrame(at.collect(), docs.schema)
    assert {r.doc_id: r.text for r in at.collect()} == want
