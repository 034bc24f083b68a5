"""Image files: decoded pixels, digests and sizes by header, one row a file, broken files as rows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file's head that sizes are looked for in; segments before the frame header of a JPEG are larger only if broken.
HEAD = 1 << 20
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def exif_orientation(block: bytes) -> int:
    """The orientation (1 to 8) in a TIFF block of either byte order; 1 if it has none or is cut off."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(block[:2]))
    if order is None or len(block) < 8 or struct.unpack_from(f"{order}H", block, 2)[0] != 42:
        return 1
    at = struct.unpack_from(f"{order}I", block, 4)[0]
    if at + 2 > len(block):
        return 1
    for k in range(struct.unpack_from(f"{order}H", block, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 10 > len(block):
            return 1
        tag, kind = struct.unpack_from(f"{order}HH", block, entry)
        if tag == 0x0112:
            value = struct.unpack_from(f"{order}H" if kind == 3 else f"{order}I", block + b"\0\0", entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def size_of(head: bytes | None) -> tuple[int, int, int] | None:
    """(width, height, orientation) as stored, from the head of a JPEG or PNG file; None if it is neither or cut off."""
    head = head or b""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        if len(head) < 24 or head[12:16] != b"IHDR":
            return None
        width, height = struct.unpack_from(">II", head, 16)
        orientation, at = 1, 8
        while at + 8 <= len(head):
            size, kind = struct.unpack_from(">I4s", head, at)
            if kind == b"eXIf":
                orientation = exif_orientation(head[at + 8 : at + 8 + size])
            if kind == b"IDAT":
                break
            at += size + 12
        return width, height, orientation
    if head[:2] != b"\xff\xd8":
        return None
    at, orientation = 2, 1
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            return None
        marker = head[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length
            at += 2
            continue
        size = struct.unpack_from(">H", head, at + 2)[0]
        if marker in _FRAMES:
            if at + 9 > len(head):
                return None
            height, width = struct.unpack_from(">HH", head, at + 5)
            return width, height, orientation
        if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            orientation = exif_orientation(head[at + 10 : at + 2 + size])
        if marker in (0xD9, 0xDA) or size < 2:
            return None
        at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "orientation")]))
def image_size(head: pd.Series) -> pd.DataFrame:
    """Width and height as shown: sides change places for orientations that turn the image by a quarter."""
    rows = []
    for h in head:
        got = size_of(bytes(h) if h is not None else None)
        rows.append((None, None, None) if got is None else (got[1], got[0], got[2]) if got[2] >= 5 else got)
    return pd.DataFrame(rows, columns=["width", "height", "orientation"]).astype("Int32")


def _files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))


def image_sizes(spark: SparkSession, root: str, extensions=("jpg", "jpeg", "png")) -> DataFrame:
    """(path, width, height, orientation) of the files below a folder, from their heads; nulls where there is no size."""
    s = image_size(F.substring("content", 1, HEAD)).alias("s")
    return _files(spark, root, extensions).select("path", s).select("path", "s.*")


def read_images(spark: SparkSession, root: str, extensions=("jpg", "jpeg", "png")) -> DataFrame:
    """(path, filename, bytes, sha256, height, width, pixels, orientation) of every image file below a folder.

    Pixels are decoded in the JVM and row-major, channels in the order blue, green, red or one gray one;
    a file that can't be decoded has null pixels. height and width are those of the pixels as stored. A
    file without a byte gives no row, Spark's readers leave it out.
    """
    files = _files(spark, root, extensions).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(image_size(F.substring("content", 1, HEAD))["orientation"], F.lit(1)).alias("orientation")
    )
    decoded = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root).select("image.*")
    ok = F.col("height") > 0
    # The two readers write a path with one slash or three after the scheme.
    pixels = decoded.select(F.regexp_replace("origin", "^file:/+", "/").alias("__p"), F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("data")).alias("pixels"))
    return files.withColumn("__p", F.regexp_replace("path", "^file:/+", "/")).join(pixels, "__p", "left").drop("__p")
