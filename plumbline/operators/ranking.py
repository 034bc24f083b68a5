"""Ranks, quantile bins, top-k picks and empirical distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written


#: Rows of a range, about, and ranges at least and at most.
ROWS_OF_RANGE, RANGES = 1 << 20, (64, 4096)
#: Sampled rows for each range, and characters or bytes of a key that cuts are made of.
SAMPLE, KEY_LENGTH = 16, 64
#: Rows that are one range without a sample; results are the same.
SMALL = 1 << 14


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a written table of the shared folder: computed once, where a checkpoint computes it twice."""
    return written(df)


def rank_first(df: DataFrame, value: str, ties: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 over the table or each group, ties in the order of the tie columns."""
    return numbered(df, by or [], [value, *ties], name, None)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers from 1 over the whole table without sorting it in one task."""
    return numbered(df, [], order, name, None)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, total: str | None, start: int = 1) -> DataFrame:
    """df with its row numbers in each sorted group, from start, and the rows of the group if total names them.

    A group is no task: rows are numbered within a range of the order columns and shifted by the sizes of
    the group's ranges before. Order columns are of any type that sorts; rows that tie on all of them
    are told apart by a hash of the row, so a column of one value is spread over ranges too. Nulls come first.
    """
    dealt = in_ranges(df, order)
    inside = dealt.withColumn("__i", F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order, "__tie")))
    out = with_shifts(inside, shifts(dealt, by, {"n": F.count("*")}), by)
    extra = [F.col("__all_n").cast("long").alias(total)] if total else []
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__i") + F.col("__before_n") + (start - 1)).cast("long").alias(name), *extra)


def _short(df: DataFrame, column: str) -> Column:
    """What a cut is made of: the first KEY_LENGTH of a text or bytes, which sorts before all that begin with it."""
    c = F.col(f"`{column}`")
    return F.substring(c, 1, KEY_LENGTH) if df.schema[column].dataType.typeName() in ("string", "binary", "char", "varchar") else c


def in_ranges(df: DataFrame, order: list[str] | str, ties: bool = True) -> DataFrame:
    """df with __range, the range of its order columns between the cuts of a sample, and __tie, a hash of the row that goes on after them.

    The number of ranges follows the table's size; what reaches the driver is one row for each cut.
    Without ties, equal keys stay in one range: for tables that have each value once, or once a group.
    """
    columns = [order] if isinstance(order, str) else order
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    dealt = df.withColumn("__tie", F.xxhash64(*hashed))
    names = [f"k{i}" for i in range(len(columns) + 1)]
    keys = [x.alias(k) for x, k in zip((*(F.col(f"`{c}`") for c in columns), F.col("__tie")), names, strict=True)]
    short = [x.alias(k) for x, k in zip((*(_short(df, c) for c in columns), F.col("__tie")), names, strict=True)]
    n = df.count()
    if n <= SMALL:
        return dealt.withColumn("__range", F.lit(0))
    ranges = max(RANGES[0], min(RANGES[1], n // ROWS_OF_RANGE))
    wanted = SAMPLE * ranges
    sample = dealt.select(*short).sample(min(1.0, wanted / max(n, 1)), seed=7)
    step = max(1, min(n, wanted) // ranges)
    # The sample has SAMPLE * RANGES rows, about, at most.
    picked = sample.withColumn("i", F.row_number().over(W.orderBy(*names))).where(F.col("i") % step == 0).orderBy("i").drop("i")
    cuts = picked.collect()
    kinds = [f.dataType for f in picked.schema]
    if not ties and len(columns) == 1:
        kind = kinds[0]
        literal = lambda row: F.lit(row[0]).cast(kind)
        key = keys[0]
        cuts = list(dict.fromkeys((r[0],) for r in cuts if r[0] is not None))
    else:
        key = F.struct(*keys)
        literal = lambda row: F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in zip(names, row, kinds, strict=True)))
    beyond = lambda among: F.size(F.filter(among, lambda c: key > c))
    if not cuts:
        at = F.lit(0)
    elif len(cuts) < 8:
        at = beyond(F.array(*map(literal, cuts)))
    else:  # in two steps: every so many cuts, then those between
        each = math.isqrt(len(cuts) - 1) + 1
        blocks = [cuts[i : i + each] for i in range(0, len(cuts), each)]
        block = beyond(F.array(*(literal(b[-1]) for b in blocks[:-1])))
        at = block * each + beyond(F.element_at(F.array(*(F.array(*map(literal, b)) for b in blocks)), block + 1))
    return dealt.withColumn("__range", at)


def shifts(dealt: DataFrame, by: list[str], sums: dict[str, Column], first: str | None = None) -> DataFrame:
    """Of each group and range, __before_x over the group's ranges before and __all_x over all; __next is the first value after the range."""
    ends = [F.min(first).alias("__first")] if first else []
    per = dealt.groupBy(*by, "__range").agg(*(c.alias(f"__s_{x}") for x, c in sums.items()), *ends)
    group = W.partitionBy(*by)
    before = group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    made = [c for x in sums for c in (F.coalesce(F.sum(f"__s_{x}").over(before), F.lit(0)).alias(f"__before_{x}"), F.sum(f"__s_{x}").over(group).alias(f"__all_{x}"))]
    return per.select(*by, "__range", *made, *([F.lead("__first").over(group.orderBy("__range")).alias("__next")] if first else []))


def with_shifts(df: DataFrame, shifted: DataFrame, by: list[str]) -> DataFrame:
    """df joined with shifts(); without groups these are as many rows as ranges at most."""
    keys = [*by, "__range"]
    right = shifted.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`"))
    return df.join(right if by else F.broadcast(right), same).drop(*(f"__of_{k}" for k in keys))


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """The bin (from 0) that cutting ranks 1..n at linear quantiles gives; not ntile()."""
    r, m = rank.cast("long") - 1, F.greatest(n.cast("long") - 1, F.lit(1))
    # ceil(r * bins / m) - 1 in whole numbers
    return F.greatest(F.call_function("div", r * bins + m - 1, m) - 1, F.lit(0)).cast("int")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def quantile_pick(df: DataFrame, by: list[str], order: list[str], quantiles: list[float]) -> DataFrame:
    """The rows at round-half-even(q (n - 1)) of each sorted group, with the column quantile."""
    picked = numbered(df, by, order, "__k", "__n", start=0).withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    return picked.where(F.col("__k") == F.rint(F.col("quantile") * (F.col("__n") - 1))).drop("__k", "__n")


def ecdf(df: DataFrame, by: list[str], order: list[str], name: str = "ecdf") -> DataFrame:
    """Places 0..1 of each row in its sorted group; 0 for a single row."""
    place = F.when(F.col("__n") > 1, F.col("__k") / (F.col("__n") - 1)).otherwise(0.0)
    return numbered(df, by, order, "__k", "__n", start=0).withColumn(name, place).drop("__k", "__n")


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks with ties at their mean. It ranks distinct values: a value costs one row of the sort."""
    keys = [*(by or []), value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    placed = running_total(cut_lineage(counts), value, ["__n"], by).withColumn(name, F.col("__total___n") - F.col("__n") + (F.col("__n") + 1) / 2)
    return df.join(placed.select(*keys, name), keys)


def running_total(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """df with __total_x, the sum of x up to and with each row of its group in the order of one column, and __all_x."""
    by, dealt = by or [], in_ranges(df, [order], ties=False)
    inside = W.partitionBy(*by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = dealt.select("*", *(F.sum(v).over(inside).alias(f"__i_{v}") for v in values))
    out = with_shifts(sums, shifts(dealt, by, {v: F.sum(v) for v in values}), by)
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__i_{v}") + F.col(f"__before_{v}")).alias(f"__total_{v}") for v in values), *(f"__all_{v}" for v in values))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], name: str = "quantiles") -> DataFrame:
    """The exact quantiles of a column in each group, interpolated, as an array; a group without values has none.

    Values are counted and the counts summed by ranges, so no task holds the values of a group. Nulls
    don't count.
    """
    v = F.col(f"`{value}`").cast("double").alias("__v")
    counts = df.select(*(F.col(f"`{c}`") for c in by), v).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    placed = running_total(cut_lineage(counts), "__v", ["__n"], by)
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)))).alias("__w")
    p = F.col("__w.q") * (F.col("__all___n") - 1)
    asked = placed.select("*", wanted).select("*", p.alias("__p"), F.col("__w.i").alias("__q"))
    holds = lambda k: (k >= F.col("__total___n") - F.col("__n")) & (k < F.col("__total___n"))
    low, high = F.floor("__p"), F.ceil("__p")
    met = asked.where(holds(low) | holds(high))
    each = met.groupBy(*by, "__q").agg(F.min("__v").alias("a"), F.max("__v").alias("b"), F.first(F.col("__p") - low).alias("f"))
    value_at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("b"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__q", value_at.alias("v")))), lambda x: x["v"]).alias(name))
