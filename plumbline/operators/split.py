"""Splitting: duplicates, near-duplicate pairs, components, strata bins, stratified group k-fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import hamming, relative_difference
from ..tables import discard, written
from .ranking import numbered, quantile_bin, rank_first


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key, its content's SHA-256, the smallest key of equal content, and how many rows share it."""
    hashed = df.select(key, F.sha2(content.cast("binary"), 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min(key).alias("group_id"), F.count("*").alias("group_size"))
    return hashed.join(groups, "sha256").select(key, "sha256", "group_id", "group_size")


def near_candidates(groups: DataFrame, head: str, bits: str, most: int, width: int) -> DataFrame:
    """Pairs of hashes (left, right, lb, rb) that may be near, each once, from a multi-index over slices.

    The width is cut into most // 2 + 1 slices: two hashes within most bits differ by one bit at most in
    one slice at least. The right hash asks for its own value of each slice and those one bit away, the
    left one is found under its own value; a pair counts in the first slice that qualifies. With slices
    of w bits that compares about (w + 1) / 2^w of all pairs a slice.
    """
    slices = most // 2 + 1
    borders = [i * width // slices for i in range(slices + 1)]
    spans = list(zip(borders[:-1], borders[1:], strict=True))
    cut = lambda x, a, b: F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1).cast("long"))
    own = F.explode(F.array(*(F.struct(F.lit(i).alias("slice"), cut(bits, a, b).alias("value")) for i, (a, b) in enumerate(spans))))

    def asked(i: int, a: int, b: int) -> Column:
        value = cut(bits, a, b)
        flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(b - a)))
        return F.transform(flips, lambda f: F.struct(F.lit(i).alias("slice"), value.bitwiseXOR(f).alias("value")))

    every = F.explode(F.flatten(F.array(*(asked(i, a, b) for i, (a, b) in enumerate(spans)))))
    left = groups.select(F.col(head).alias("left"), F.col(bits).alias("lb"), own.alias("s")).select("left", "lb", "s.slice", "s.value")
    right = groups.select(F.col(head).alias("right"), F.col(bits).alias("rb"), every.alias("s")).select("right", "rb", "s.slice", "s.value")
    met = left.join(right, ["slice", "value"]).where(F.col("left") < F.col("right"))
    x = F.col("lb").bitwiseXOR(F.col("rb"))
    earlier = F.lit(False)
    for i, (a, b) in enumerate(spans):
        earlier = earlier | ((F.col("slice") > i) & (F.bit_count(cut(x, a, b)) <= 1))
    return met.where(~earlier).drop("slice", "value")


#: Hashes of a block, and rows of a block that are compared at once.
BLOCK, ROWS = 1 << 14, 64
#: The multi-index is used where it compares one pair in so many or fewer: a joined row costs as much as many in a block.
INDEX_SHARE = 128


def compared_share(groups: DataFrame, bits: str, most: int, width: int) -> float:
    """The share of all pairs of hashes that near_candidates() would compare: large where bits are uneven."""
    slices = most // 2 + 1
    borders = [i * width // slices for i in range(slices + 1)]
    total, n = 0, groups.count()
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        value = F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1).cast("long"))
        held = groups.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(b - a)))
        asked = held.select(F.col("n").alias("m"), F.explode(F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
        total += held.join(asked, "value").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    return total / (n * n) if n else 0.0


def block_pairs(groups: DataFrame, head: str, bits: str, most: int) -> DataFrame:
    """Pairs of hashes (left, right, lb, rb, distance) within most bits, from all pairs of blocks of hashes.

    Every two blocks meet in one task, which holds no more than them; the work is that of all pairs, at
    about a nanosecond each.
    """
    n = groups.count()
    parts = max(-(-n // BLOCK), min(16, -(-n // 512)), 1)
    blocks = groups.select(F.pmod(F.xxhash64(bits, F.lit(3)), F.lit(parts)).cast("int").alias("b"), F.col(head).cast("long").alias("h"), F.col(bits).alias("x"))
    blocks = blocks.groupBy("b").agg(F.collect_list(F.struct("h", "x")).alias("rows")).select("b", F.col("rows.h").alias("h"), F.col("rows.x").alias("x"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o")
    met = blocks.select("b", "h", "x", other).select(F.least("b", "o").alias("u"), F.greatest("b", "o").alias("v"), "h", "x")
    dealt = met.repartition(min(parts * (parts + 1) // 2, 2048), "u", "v").sortWithinPartitions("u", "v")

    def near(p, q):
        own = p is q
        for a in range(0, len(p[0]), ROWS):
            distance = np.bitwise_count(p[1][a : a + ROWS, None] ^ q[1][None, :])
            i, j = np.nonzero(distance <= most)
            d, i = distance[i, j], i + a
            if own:
                keep = i < j
                i, j, d = i[keep], j[keep], d[keep]
            if not len(i):
                continue
            left, right, lb, rb = p[0][i], q[0][j], p[1][i], q[1][j]
            turned = left > right
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            lb, rb = np.where(turned, rb, lb).view(np.int64), np.where(turned, lb, rb).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (left, right, lb, rb)] + [pa.array(d, pa.int32())], ["left", "right", "lb", "rb", "distance"])

    def run(batches):
        key, held = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                now = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                block = tuple(batch.column(c)[r].values.to_numpy().view(t) for c, t in ((2, np.int64), (3, np.uint64)))
                if now[0] == now[1]:
                    yield from near(block, block)
                elif now != key:
                    key, held = now, tuple(x.copy() for x in block)
                else:
                    yield from near(held, block)

    kind = groups.schema[head].dataType.simpleString()
    found = dealt.mapInArrow(run, "left long, right long, lb long, rb long, distance int")
    return found.select(F.col("left").cast(kind).alias("left"), F.col("right").cast(kind).alias("right"), "lb", "rb", "distance")


def _grouped_pairs(df: DataFrame, key: str, bits: str, most: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct hashes with their smallest key, and the pairs of them within most bits.

    Uneven bits crowd the slices of the multi-index; then blocks of hashes meet in place of it. Keys that
    are no whole numbers have the multi-index only.
    """
    if most >= width:
        raise ValueError("every pair is within most bits")
    groups = df.where(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("head"))
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        groups = written(groups)
        if compared_share(groups, bits, most, width) * INDEX_SHARE > 1:
            return groups, block_pairs(groups, "head", bits, most)
    distance = hamming(F.col("lb"), F.col("rb"))
    return groups, near_candidates(groups, "head", bits, most, width).where(distance <= most).withColumn("distance", distance)


def every_near_pair(df: DataFrame, key: str, bits: str = "phash", most: int = 8, width: int = 64) -> DataFrame:
    """All pairs of keys (left < right) whose hashes differ in at most most bits, those of equal hashes too.

    Distinct hashes are compared once, as for near_pairs(), then their members are paired. There may be
    far more pairs than hashes, by whose number Spark judges their size, so they are never broadcast.
    """
    _, found = _grouped_pairs(df, key, bits, most, width)
    members = df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("x"))
    a, b = members.select(F.col("k").alias("a"), F.col("x").alias("lb")), members.select(F.col("k").alias("b"), F.col("x").alias("rb"))
    lefts = found.select("lb", "rb", "distance").hint("merge").join(a, "lb")
    between = lefts.hint("merge").join(b, "rb").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "distance")
    inside = a.join(b, F.col("lb") == F.col("rb")).where("a < b").select(F.col("a").alias("left"), F.col("b").alias("right"), F.lit(0).alias("distance"))
    return between.unionByName(inside)


def near_pairs(df: DataFrame, key: str, bits: str = "phash", most: int = 8, width: int = 64) -> DataFrame:
    """Pairs of keys (left < right) whose hashes differ in at most most bits; no pair of different hashes is lost (see near_candidates()).

    Equal hashes are grouped first and compared once; their members are paired with the group's
    smallest key, so a large group of copies gives a star and not all its pairs (every_near_pair() gives
    them).
    """
    groups, found = _grouped_pairs(df, key, bits, most, width)
    between = found.select("left", "right", "distance")
    inside = df.where(F.col(bits).isNotNull()).join(groups, bits).where(F.col(key) != F.col("head")).select(F.col("head").alias("left"), F.col(key).alias("right"), F.lit(0).alias("distance"))
    return between.unionByName(inside)


def accept_rule(exact: Column, distance: Column, correlation: Column, left_words: Column, right_words: Column) -> Column:
    """Name of the rule that accepts a candidate pair, empty if none does."""
    close = relative_difference(left_words, right_words) <= 0.10
    return (
        F.when(exact, "exact_sha256")
        .when((distance <= 2) & close, "phash_le2_words_le10pct")
        .when((distance <= 6) & (correlation >= 0.90) & close, "phash_le6_corr_ge090_words_le10pct")
        .otherwise("")
    )


def contracted(edges: DataFrame, a: str = "left", b: str = "right") -> list[DataFrame]:
    """Tables (u, to), one a round: where each node of the graph that the rounds before left goes; the first has all nodes of the edges.

    A node goes to the neighbour, or stays, that has the smallest hash, and on to where that one goes.
    Hashes are drawn anew every second round, so the order of names means nothing: a third of a chain's
    nodes or less are left after a round, whatever their names, a star is gone after two.
    """
    e = written(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        draw = F.lit(len(steps) // 2)
        ranked = lambda node: F.struct(F.xxhash64(node, draw).alias("h"), F.col(node).alias("n"))
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(ranked("v")).alias("m")).select("u", F.least("m", ranked("u"))["n"].alias("to"))
        near = written(near)
        step = written(near.join(near.select(F.col("u").alias("to"), F.col("to").alias("next")), "to").select("u", F.col("next").alias("to")))
        p, q = step.select("u", F.col("to").alias("x")), step.select(F.col("u").alias("v"), F.col("to").alias("y"))
        left = written(e.join(p, "u").join(q, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        discard(near, e)
        steps.append(step)
        e = left
    discard(e)
    return steps


def components(edges: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """(node, label): label is the smallest node of the component, for every node of an edge.

    Nodes are contracted in rounds whose number grows with the logarithm of the nodes and whose tables
    shrink; where each node ended is then looked up from the last round back to the first.
    """
    steps = contracted(edges, a, b)
    if not steps:
        return edges.select(F.col(a).alias("node"), F.col(b).alias("label")).limit(0)
    ends = steps.pop()
    while steps:
        step = steps.pop()
        further = ends.select(F.col("u").alias("to"), F.col("to").alias("end"))
        known = written(step.join(further, "to", "left").select("u", F.coalesce("end", "to").alias("to")))
        discard(step, ends)
        ends = known
    least = ends.groupBy("to").agg(F.min("u").alias("label"))
    return ends.join(least, "to").select(F.col("u").alias("node"), "label")


def stratum_bins(df: DataFrame, first: str, second: str, ties: list[str], bins: tuple[int, int] = (5, 2)) -> DataFrame:
    """Rank bins of two features and the stratum name made of both."""
    n = df.count()
    out = rank_first(rank_first(df, first, ties, name="__r1"), second, ties, name="__r2")
    out = out.withColumn("first_bin", quantile_bin(F.col("__r1"), F.lit(n), bins[0])).withColumn("second_bin", quantile_bin(F.col("__r2"), F.lit(n), bins[1]))
    return out.withColumn("stratum", F.concat(F.lit("w"), "first_bin", F.lit("_s"), "second_bin")).drop("__r1", "__r2")


def assign_groups(counts: pd.DataFrame, folds: int) -> dict:
    """Greedy stratified folds of groups (rows: group, stratum, n).

    Groups with the most uneven class counts come first; each goes to the fold that leaves the mean
    deviation of class shares over folds least, ties to the fold with fewer rows.
    """
    table = counts.pivot_table(index="group", columns="stratum", values="n", aggfunc="sum", fill_value=0).sort_index()
    x = table.to_numpy(float)
    share = x.sum(axis=0)
    share[share == 0] = 1
    held, out = np.zeros((folds, x.shape[1])), {}
    for i in np.argsort(-x.std(axis=1), kind="stable"):
        best = None
        for f in range(folds):
            held[f] += x[i]
            value = (round(float((held / share).std(axis=0).mean()), 12), held[f].sum(), f)
            held[f] -= x[i]
            best = value if best is None or value < best else best
        held[best[2]] += x[i]
        out[table.index[i]] = best[2]
    return out


def group_kfold(df: DataFrame, group: str, stratum: str, folds: int = 5, blocks: int = 64) -> DataFrame:
    """df with fold: groups stay whole and strata are balanced.

    The greedy order is sequential, so groups are dealt to blocks by hash and each block is balanced on
    its own, as one task; blocks = 1 gives the single greedy pass over all groups.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("n")).select(F.col(group).alias("group"), F.col(stratum).alias("stratum"), "n")
    counts = counts.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)) if blocks > 1 else F.lit(0))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign_groups(pdf, folds)
        return pd.DataFrame({"group": list(got), "fold": list(got.values())})

    placed = counts.groupBy("block").applyInPandas(place, f"group {counts.schema['group'].dataType.simpleString()}, fold int")
    return df.join(placed.withColumnRenamed("group", group), group)


def fold_views(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def fold_checks(df: DataFrame, key: str, fold: str = "fold", manifest: DataFrame | None = None) -> DataFrame:
    """Per fold: rows to train on and to validate on, keys that other folds have too, and whether both sides are disjoint and cover the manifest.

    uncovered counts the keys of the manifest (or of df itself) that no row with a fold has; exhaustive
    says that there are none. Rows without a fold belong to no side.
    """
    placed = df.where(F.col(fold).isNotNull())
    keys = (df if manifest is None else manifest).select(key).distinct()
    uncovered = keys.join(placed.select(key), key, "left_anti").agg(F.count("*").alias("uncovered"))
    sizes = placed.groupBy(fold).agg(F.count("*").alias("validation"))
    total = placed.agg(F.count("*").alias("rows"))
    # Of a key only the least and the greatest fold are held.
    spread = placed.groupBy(key).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).where("a <> b").select(key)
    shared = placed.select(key, fold).distinct().join(spread, key, "left_semi").groupBy(fold).agg(F.count("*").alias("shared"))
    out = sizes.join(F.broadcast(total)).join(F.broadcast(uncovered)).join(shared, fold, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(fold, (F.col("rows") - F.col("validation")).alias("training"), "validation", "shared", "uncovered", (F.col("shared") == 0).alias("disjoint"), (F.col("uncovered") == 0).alias("exhaustive"))


def weighted_sample(df: DataFrame, family: str, n: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """n draws with replacement, every family equally likely and its rows equally likely within.

    Draw i picks a family and a place in it by hashes of (seed, i); rows are numbered in their family
    by key. Only draws and numbered keys are joined.
    """
    order = key or family
    sizes = df.groupBy(family).agg(F.count("*").alias("__n"))
    families = sizes.withColumn("__f", F.row_number().over(W.orderBy(family)) - 1).withColumn("__families", F.count("*").over(W.partitionBy()))
    unit = lambda salt: F.pmod(F.xxhash64(F.col("draw"), F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    total = families.agg(F.max("__families").alias("__t"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total))
    draws = draws.withColumn("__f", F.floor(unit(1) * F.col("__t"))).join(F.broadcast(families), "__f").withColumn("__k", F.floor(unit(2) * F.col("__n")) + 1)
    places = numbered(df, [family], [order], "__k", None)
    return draws.select("draw", family, "__k").join(places, [family, "__k"]).drop("__k")
