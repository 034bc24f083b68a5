"""Registered queries that write files made of the tables and read them back, and what sinks print."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import probability_maps
from ..sources import annotations, sinks
from ..tables import shared_folder
from . import boxes as B
from .boxes import table
from .catalog import query

SPLITS = ("train", "val", "test")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


@query(f"WITH {B.LINES} SELECT ['train', 'val', 'test'][image % 3 + 1] AS dataset, count(DISTINCT image) AS images, count(*) AS words, sum(25 * k)::DOUBLE AS x_sum FROM li GROUP BY 1")
def annotation_files(spark, sf_dir):
    """Annotations of all images written as JSON files in nested folders by split, read back and tagged."""
    word = F.concat(F.lit('"'), F.lpad(F.col("k").cast("string"), 4, "0"), F.lit('":{"points":'), F.concat(F.lit("[["), (25 * F.col("k")).cast("string"), F.lit(".0,0.0],["), (25 * F.col("k") + 5).cast("string"), F.lit(".0,9.0]]")), F.lit("}"))
    rows = B.lines(spark, sf_dir).select("image", word.alias("word"))
    images = rows.groupBy("image").agg(F.array_join(F.collect_list("word"), ",").alias("words"))
    entry = F.concat(F.lit('"'), F.col("image").cast("string"), F.lit('.jpg":{"words":{'), "words", F.lit('},"img_w":640,"img_h":480}'))
    split = F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("image") % 3 + 1).cast("int"))
    # A file holds a bounded share of the images, and is one document.
    files = images.select(split.alias("split"), F.pmod(F.xxhash64("image"), F.lit(16)).alias("part"), entry.alias("entry")).groupBy("split", "part").agg(F.array_join(F.collect_list("entry"), ",").alias("entries"))
    folder = _folder(spark)
    files.select("split", "part", F.concat(F.lit('{"images":{'), "entries", F.lit("}}")).alias("value")).write.partitionBy("split", "part").text(folder)
    read = annotations.tagged(**{s: annotations.read_documents(spark, f"{folder}/split={s}/*") for s in SPLITS})
    words = annotations.words(read).groupBy("filename").agg(F.count("*").alias("n"), F.sum(F.col("polygon")[0]["x"]).alias("x"))
    per = read.join(words, "filename").groupBy("dataset").agg(F.count("*").alias("images"), F.sum("n").alias("words"), F.sum("x").alias("x_sum"))
    return per


@query("SELECT o_orderkey, printf('%.10g', o_totalprice / 7) AS seventh, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE printf('%.10g', o_totalprice * 1e-12 * o_orderkey) END AS small FROM orders")
def csv_numbers(spark, sf_dir):
    """Numbers written to CSV files with ten significant digits, NaN as empty, and read back as text."""
    v, k = F.col("o_totalprice"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (v / 7).alias("seventh"), F.when(k % 3 == 0, float("nan")).otherwise(v * 1e-12 * k).alias("small"))
    folder = _folder(spark)
    sinks.write_csv(rows, folder, digits=10)
    return annotations.read_csv(spark, folder, "o_orderkey long, seventh string, small string").fillna("", ["small"])


@query("SELECT 0::INT AS line, '| o_orderpriority | n | mean |' AS text UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT (row_number() OVER (ORDER BY o_orderpriority) + 1)::INT, '| ' || o_orderpriority || ' | ' || count(*) || ' | ' || printf('%.4f', avg(o_totalprice)) || ' |' FROM orders GROUP BY o_orderpriority")
def markdown_report(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    text = sinks.markdown(per.orderBy("o_orderpriority"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@query("SELECT c_custkey AS image, least(2 + c_custkey % 5, 4)::BIGINT AS polygons FROM customer")
def candidate_cap(spark, sf_dir):
    """Two to six bright squares in each map, of which the first four borders are candidates."""
    i = F.col("c_custkey")
    dark, bright = F.lit(0.1).cast("float"), F.lit(0.9).cast("float")
    empty, square, n = B.stretch((dark, 60)), B.stretch((dark, 2), (bright, 6), (dark, 2)), 2 + i % 5
    held = F.concat(F.flatten(B.stretch((square, n))), B.stretch((dark, 60 - 10 * n)))
    values = F.flatten(B.stretch((empty, 3), (held, 6), (empty, 3)))
    maps = B.dealt(table(spark, sf_dir, "customer"), "c_custkey").select(i.alias("image"), F.lit(12).alias("height"), F.lit(60).alias("width"), values.alias("values"))
    settings = probability_maps.Settings(threshold=0.5, box_threshold=0.5, most_candidates=4, unclip_ratio=1.0)
    return probability_maps.detect_polygons(maps, settings).groupBy("image").agg(F.count("*").alias("polygons"))


@query()
def common_subsequences(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.select("c_custkey", S.common_subsequence(F.lower("c_name"), F.lower("c_mktsegment"))["length"].alias("length"))
