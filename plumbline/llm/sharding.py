"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number (its place in an order of the rows' content), a keyed Feistel
network permutes the numbers 0..n-1, and the permuted number p gives shard p mod k and slot p div k.
So shard sizes differ by one row at most, slots have no gaps, the shuffle is the same on every run
and every cluster, and both directions can be computed without the table: ``place`` from a row
number, ``row_at`` from a shard and slot.

The network works on a grid of a x b cells, the smallest near-square one that holds n. Numbers that
land outside 0..n-1 walk on through the network until they are inside (cycle walking). Fewer than a
cells are outside, a share of about 1/sqrt(n), so walks are short; WALKS bounds them and a longer
walk fails the query, it never gives a wrong place.

All of it is DataFrame functions: no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Even, so that the halves end where they began.
ROUNDS = 6
WALKS = 32
#: Equal rows are spread out again in arrays of this many numbers at most.
COPY_BLOCK = 4096
#: Distinct rows of a bucket, at most on average, once there are more than 4096 times as many.
BUCKET_ROWS = 250_000
_MULTIPLIER = 2654435761
_MODULUS = 2147483647


def _grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round_value(half, round_key):
    """Mixes a half (under 2^31) with a round key, in numbers that fit 63 bits; ints or Columns."""
    x = (half + round_key) % _MODULUS
    x = (x * x + _MULTIPLIER) % _MODULUS
    return (x * 48271 + round_key) % _MODULUS


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    keys, x = [], (seed * 6364136223846793005 + 1442695040888963407) % 2**64
    for _ in range(rounds):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        keys.append((x >> 33) % _MODULUS)
    return keys


def permute(row: int, n: int, seed: int) -> int:
    """The permuted number of row, as the DataFrame form computes it."""
    a, b = _grid(n)
    x = row
    for _ in range(WALKS):
        left, right = divmod(x, b)
        for i, key in enumerate(round_keys(seed)):
            m = (a, b)[i % 2]
            left, right = right, (left + _round_value(right, key)) % m
        x = left * b + right
        if x < n:
            return x
    raise ValueError("a walk is longer than WALKS")


def invert(place: int, n: int, seed: int) -> int:
    """The row whose permuted number is place."""
    a, b = _grid(n)
    x = place
    for _ in range(WALKS):
        left, right = divmod(x, b)
        for i, key in reversed(list(enumerate(round_keys(seed)))):
            m = (a, b)[i % 2]
            left, right = (right - _round_value(left, key)) % m, left
        x = left * b + right
        if x < n:
            return x
    raise ValueError("a walk is longer than WALKS")


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    return invert(slot * shards + shard, n, seed)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def permuted(row: Column, n: Column, seed: int) -> Column:
    """permute() as an expression; n is a column, the same in all rows."""
    root = F.floor(F.sqrt((n - 1).cast("double"))).cast("long")  # may be one off beyond 2^52
    root = F.when(root * root > n - 1, root - 1).when((root + 1) * (root + 1) <= n - 1, root + 1).otherwise(root)
    a = root + 1
    b = _div(n + a - 1, a)
    keys = F.array(*(F.lit(k).cast("long") for k in round_keys(seed)))

    def network(x: Column) -> Column:
        start = F.struct(_div(x, b).alias("left"), F.pmod(x, b).alias("right"), F.lit(0).alias("i"))

        def step(s: Column, key: Column) -> Column:
            m = F.when(s["i"] % 2 == 0, a).otherwise(b)
            return F.struct(
                s["right"].alias("left"),
                F.pmod(s["left"] + _round_value(s["right"], key), m).alias("right"),
                (s["i"] + 1).alias("i"),
            )

        return F.aggregate(keys, start, step, lambda s: s["left"] * b + s["right"])

    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALKS)),
        network(row),
        lambda x, _: F.when(x < n, x).otherwise(network(x)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk is longer than WALKS")).cast("long"))


def number_rows(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """df's distinct key rows, with their copies numbered one after another over the whole table.

    Adds row_number (long, from 0) and n_rows. Rows are ordered by a hash bucket of all keys, then
    by the keys; equal rows are interchangeable and get successive numbers. No task sees more than a
    bucket of distinct rows; copies are counted before the shuffle, so a hot key costs one row. df is
    read once, its distinct key rows are written to the shared folder. The table of bucket offsets is
    broadcast: it has 4096 rows, or one for each BUCKET_ROWS distinct rows where these are more.
    """
    cols = [F.col(c) for c in keys]
    runs = checkpointed(df.groupBy(*cols).agg(F.count("*").alias("__copies")))
    buckets = buckets or max(4096, runs.count() // BUCKET_ROWS)
    runs = runs.withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    sizes = runs.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(every.orderBy("__bucket")).alias("n_rows"),
    )
    inside = W.partitionBy("__bucket").orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    return (
        runs.withColumn("__before", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPY_BLOCK).cast("long"))))
        .withColumn("__copy", F.explode(F.sequence(F.col("__block"), F.least(F.col("__block") + COPY_BLOCK, F.col("__copies")) - 1)))
        .withColumn("row_number", F.col("__offset") + F.col("__before") + F.col("__copy"))
        .select(*keys, "row_number", "n_rows")
    )


def shard_rows(df: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Places every row of df in a shard and slot, under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes + 8; a null text has none), text_crc32 (0 for null), law,
    shard, slot, grown_shard (null under this law), row_number, permuted. Nulls of doc_id sort first
    and count as rows; repeated rows get a place each; an empty table gives no rows; other columns
    of df are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered = number_rows(rows, ["doc_id", "size", "text_crc32"], buckets)
    p = F.col("permuted")
    return numbered.withColumn("permuted", permuted(F.col("row_number"), F.col("n_rows"), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(p, F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"permuted div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
        "permuted",
    )
