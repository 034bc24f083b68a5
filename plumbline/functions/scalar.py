"""Scalar functions with the edge rules of the evaluation: guarded division, half-even rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Machine epsilon of a 32-bit float, as aspect ratios are guarded with.
EPS = 1.1920928955078125e-07


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive (or null)."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def guarded_ratio(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(floor))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2.0 * a * b / (a + b))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def half_even(c: Column) -> Column:
    return F.rint(c)


def truncate(c: Column) -> Column:
    """Toward zero, as a double."""
    return c.cast("int").cast("double")


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, high if isinstance(high, Column) else F.lit(high)))


def padded_index(c: Column) -> Column:
    """Four digits at least; longer numbers stay whole."""
    return F.format_string("%04d", c)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def entropy_bits(p: Column) -> Column:
    """The term of one outcome; sum it over outcomes."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centred_cosine(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; without variance 1 if the means are equal, else 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    ca, cb = F.transform(a, lambda x: x - mean(a)), F.transform(b, lambda x: x - mean(b))
    norm = F.sqrt(_dot(ca, ca)) * F.sqrt(_dot(cb, cb))
    return F.when(norm == 0, F.when(mean(a) == mean(b), 1.0).otherwise(0.0)).otherwise(_dot(ca, cb) / norm)


def general_format(value: Column, digits: int = 10) -> Column:
    """A number with so many significant digits and no zeros at its end, as C's %g has it; null and NaN give the empty text."""

    @F.pandas_udf(T.StringType())
    def shown(v: pd.Series) -> pd.Series:
        return v.map(lambda x: "" if x is None or x != x else f"{x:.{digits}g}")

    return F.coalesce(shown(value.cast("double")), F.lit(""))


@F.pandas_udf(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("text", T.StringType())]))
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """longest_common_subsequence() of two text columns; null if either is."""
    rows = [(None, None) if x is None or y is None else longest_common_subsequence(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["length", "text"]).astype({"length": "Int32"})


def longest_common_subsequence(a: str, b: str) -> tuple[int, str]:
    """Length and text of a longest common subsequence."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = 1 + table[i + 1][j + 1] if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return table[0][0], "".join(out)
