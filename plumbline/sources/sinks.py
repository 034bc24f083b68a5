"""Writers: frames as CSV, predictions as nested JSON, submissions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import general_format, padded_index


def write_csv(df: DataFrame, path: str, mode: str = "error", digits: int | None = None) -> None:
    """One header a file; the number of files is that of df's partitions.

    digits gives floating numbers as %.{digits}g, NaN as empty.
    """
    if digits:
        shown = lambda f: general_format(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name)
        df = df.select(*map(shown, df.schema.fields))
    df.write.mode(mode).option("header", "true").csv(path)


def encode_polygon(flat: Column) -> Column:
    return F.array_join(F.transform(flat, lambda v: v.cast("string")), " ")


def submission(boxes: DataFrame, image: str = "image", order: str = "k", flat: str = "flat") -> DataFrame:
    """(filename, polygons) rows: boxes of an image in order, points joined by spaces, polygons by bars."""
    listed = boxes.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(order, encode_polygon(F.col(flat)).alias("p")))).alias("all"))
    return listed.select(F.col(image).alias("filename"), F.array_join(F.transform("all", lambda s: s["p"]), "|").alias("polygons"))


def prediction_json(boxes: DataFrame, image: str = "image", order: str = "k", polygon: str = "polygon") -> DataFrame:
    """(filename, json): one JSON object an image, words numbered from 0001 in order."""
    points = F.transform(polygon, lambda p: F.array(p["x"], p["y"]))
    listed = boxes.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(order, points.alias("points")))).alias("all"))
    entries = F.transform("all", lambda s, i: F.struct(padded_index(i + 1).alias("key"), F.struct(s["points"].alias("points")).alias("value")))
    return listed.select(F.col(image).alias("filename"), F.to_json(F.struct(F.map_from_entries(entries).alias("words"))).alias("json"))


def report_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct("*")).alias("json"))


def markdown(df: DataFrame, decimals: int = 4, most: int = 200) -> str:
    """A small result as a table; it refuses more rows than most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a table")
    show = lambda v: "" if v is None or v != v else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
