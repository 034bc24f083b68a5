"""Dropout is drawn for each occurrence of a word."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import merge_dropout, token_transducer  # noqa: E402


def test_each_occurrence_is_cut_on_its_own():
    codec = merge_dropout.Codec(token_transducer.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), 0.1)
    text = " ".join(["information", "x" * 70, "naïve🎉", "the"] * 500)
    words = merge_dropout._WORD.findall(codec.v.normalized(text))
    cuts = [codec.pieces(w, int(k)) for w, k in zip(words, codec.occurrence_keys("7", len(words)), strict=True)]
    assert codec.encode(text, "7") == [i for c in cuts for i in codec._piece_ids(c)]
    assert len({tuple(c) for w, c in zip(words, cuts, strict=True) if w.endswith("information")}) > 10
    assert codec.encode(text, "7") != codec.encode(text, "8")


def test_ids_with_line_breaks(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [("x\ny", "hello world"), ("x", "y\nhello world"), (None, "a\nb"), ("", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert all(r.lossless for r in merge_dropout.encoding_digests(df, path).collect())
    back = merge_dropout.decode_documents(merge_dropout.encode_documents(df, path), path).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in rows}
