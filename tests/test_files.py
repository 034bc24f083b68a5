"""Scans of image folders, number formats, subsequences of texts."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators.validate import ContractError
from plumbline.sources import annotations, sinks


def test_scan_sources(spark, tmp_path):
    for name in ("a/deep/1.jpg", "a/2.JPEG", "a/notes.txt", "b/3.png", "c/4.gif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    roots = {k: str(tmp_path / k) for k in "ab"}
    got = annotations.scan_sources(spark, roots, {"a": "one", "b": "two"}).select("filename", "source", "family").collect()
    assert sorted(map(tuple, got)) == [("1.jpg", "a", "one"), ("2.JPEG", "a", "one"), ("3.png", "b", "two")]
    for bad, families in (({"c": str(tmp_path / "c")}, {"c": "x"}), ({"d": str(tmp_path / "none")}, {"d": "x"}), ({"a": roots["a"]}, {}), ({}, {})):
        with pytest.raises(ContractError):
            annotations.scan_sources(spark, bad, families)


def test_general_format(spark, tmp_path):
    values = [0.0, 1.0, -2.5, 1 / 3, 1e10, 12345678901.5, 1e-5, 123456.7890123, float("inf"), float("nan"), None, 1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r["i"]: r["s"] for r in df.select("i", S.general_format(F.col("v")).alias("s")).collect()}
    assert got == {i: "" if v is None or v != v else "%.10g" % v for i, v in enumerate(values)}
    sinks.write_csv(df.where("i < 4").coalesce(1), str(tmp_path / "out"), digits=3)
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines == ["i,v", "0,0", "1,1", "2,-2.5", "3,0.333"]


def test_common_subsequence(spark):
    rows = [("kitten", "sitting", 4), ("", "x", 0), ("abc", "abc", 3), (None, "x", None)]
    got = spark.createDataFrame(rows, "a string, b string, n int").select("n", S.common_subsequence("a", "b").alias("c")).collect()
    assert [(r["c"]["length"]) for r in got] == [r[2] for r in rows] and got[0]["c"]["text"] == "ittn"


def test_folder_with_an_extension_is_one_file(spark, tmp_path):
    """Tables of many parts are listed by their own name; the root's name doesn't count."""
    root = tmp_path / "set.parquet"
    for name, size in (("a.parquet/part-0.parquet", 2), ("a.parquet/part-1.parquet", 3), ("b.parquet", 1), ("deep/c.parquet/k=1/part-0.parquet", 4), ("d.txt/e", 1)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    got = annotations.list_images(spark, str(root), extensions=("parquet",)).collect()
    assert sorted((r.filename, r.bytes) for r in got) == [("a.parquet", 5), ("b.parquet", 1), ("c.parquet", 4)]


def test_numbers_of_more_than_six_digits(spark):
    rows = spark.createDataFrame([("images/1234567.jpg",), ("000012.jpg",), ("12345.jpg",), ("9000000000.jpg",)], "f string")
    assert [r[0] for r in rows.select(annotations.numeric_id(F.col("f"))).collect()] == [1234567, 12, None, None]
