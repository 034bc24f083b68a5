"""Product-quantised vector codes, the nearest codebook entry found by annular norm pruning.

A vector's components become integers, it is cut into parts, and each part has a codebook that a
fixed number of rounds refines. The nearest entry of a part is found by norms: entries are kept in
order of norm; an entry at distance d of a vector has a norm within d of the vector's, so once some
entry is known to be at distance d, binary search gives the interval of entries that can be as near,
and only that annulus is evaluated, bounds included. The first d comes from the entries next to the
vector's norm. A block of vectors with like norms shares one annulus, which is a slice of the sorted
entries, so a block is one matrix product.

All numbers are exact integers: float64 products where they stay under 2^53, int64 under 2^62,
Python's integers beyond. A round is one pass over the table: each task sums its vectors by entry,
and 1024 sums and counts a task are added up by Spark; what reaches the driver is one row for each
entry, whatever the table's size. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release_memory

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of like norm that share an annulus, and entries next to a norm that give the first distance.
BLOCK, FIRST = 512, 8
#: Vectors that are held as integers at a time.
CHUNK = 1 << 14
#: Rows of a label are dealt to this many tasks when they get its sum.
SALTS = 16
_LIMB = 62
MOST = 2**63 - 1


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: int64, or Python's integers where that is too small. scale is a power of two."""
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    ratios = (v.as_integer_ratio() for v in x.ravel().tolist())
    return np.array([*(scale * a // b for a, b in ratios), None], object)[:-1].reshape(x.shape)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms to within 1; Python's integers are rounded down."""
    if x.dtype == object:
        return np.array([*(math.isqrt(sum(v * v for v in row)) for row in x.tolist()), None], object)[:-1]
    return np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: as float64 if x is, else by differences."""
    if x.dtype == np.float64:
        return np.square(x).sum(axis=1)[:, None] + np.square(entries).sum(axis=1)[None, :] - 2 * (x @ entries.T)
    diff = x[:, None, :] - entries[None, :, :]
    return (diff * diff).sum(axis=2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index.

    Integers of any size; distances are int64 or Python's integers.
    """
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = x.shape[1] * (_largest(x) + _largest(entries)) ** 2
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    x, entries = x.astype(kind), entries.astype(kind)
    norms = _norms(entries)
    order = np.argsort(norms, kind="stable")
    entries, norms = entries[order], norms[order]
    own = _norms(x)
    at = np.empty(len(x), np.int64)
    least = np.empty(len(x), object if kind is object else np.int64)
    rows = np.argsort(own, kind="stable")
    for a in range(0, len(rows), BLOCK):
        block = rows[a : a + BLOCK]
        lowest, highest = own[block[0]], own[block[-1]]
        middle = np.searchsorted(norms, own[block[len(block) // 2]])
        first = slice(max(0, middle - FIRST), middle + FIRST)
        seen = _distances(x[block], entries[first]).min(axis=1)
        if kind is object:
            reach = math.isqrt(max(seen)) + 3  # norms are rounded
        else:
            reach = math.sqrt(seen.max()) * (1 + 1e-12) + 1
        start, stop = np.searchsorted(norms, lowest - reach, "left"), np.searchsorted(norms, highest + reach, "right")
        d = _distances(x[block], entries[start:stop])
        best = d.min(axis=1)
        index = np.where(d == best[:, None], order[start:stop][None, :], len(order)).min(axis=1)
        at[block], least[block] = index, best
    return at, least


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, and where the parts of a vector begin and end."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    bounds: tuple[int, ...]

    def arrays(self) -> list[np.ndarray]:
        out = []
        for k, part in enumerate(self.entries):
            width = self.bounds[k + 1] - self.bounds[k]
            kind = np.int64 if all(abs(v) < 2**62 for e in part for v in e) else object
            out.append(np.array(part, kind).reshape(len(part), width))
        return out

    def sha256(self) -> str:
        """Of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def _matrices(column: pa.Array, width: int):
    """Integer matrices of a batch's vectors, CHUNK rows at a time, and where they begin."""
    for a in range(0, len(column), CHUNK):
        part = column.slice(a, CHUNK)
        yield a, integers(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), width))


def _limbs(totals: np.ndarray):
    """(limb, numbers) whose sum of numbers * 2^(62 * limb) are the totals."""
    if totals.dtype != object:
        yield 0, totals.tolist()
        return
    limb, left = 0, totals.tolist()
    while any(left) or not limb:
        yield limb, [(abs(v) & (1 << _LIMB) - 1) * (1 if v >= 0 else -1) for v in left]
        left = [(abs(v) >> _LIMB) * (1 if v >= 0 else -1) for v in left]
        limb += 1


def _sums(books: Codebooks, parts: int):
    """Rows (entry, limb, n, sums) of a task's vectors: how many each entry got, and the sums of their parts."""
    widths = [books.bounds[k + 1] - books.bounds[k] for k in range(parts)]

    def run(batches):
        entries = books.arrays()
        counts = [np.zeros(len(e), np.int64) for e in entries]
        totals = [np.zeros(e.shape, np.int64) for e in entries]
        for batch in batches:
            for _, x in _matrices(batch.column(0), books.bounds[-1]):
                for k in range(parts):
                    mine = x[:, books.bounds[k] : books.bounds[k + 1]]
                    at, _ = nearest(mine, entries[k])
                    order = np.argsort(at, kind="stable")
                    used, starts, n = np.unique(at[order], return_index=True, return_counts=True)
                    if mine.dtype == object or _largest(mine) * len(mine) + _largest(totals[k]) > 2**62:
                        totals[k], mine = totals[k].astype(object), mine.astype(object)
                    totals[k][used] += np.add.reduceat(mine[order], starts, axis=0)
                    counts[k][used] += n
        for k in range(parts):
            for e in np.nonzero(counts[k])[0].tolist():
                for limb, numbers in _limbs(totals[k][e]):
                    padded = [*numbers, *[0] * (max(widths) - len(numbers))]
                    yield pa.RecordBatch.from_pydict({"entry": pa.array([k << 16 | e], pa.int32()), "limb": pa.array([limb], pa.int32()), "n": pa.array([0 if limb else int(counts[k][e])], pa.int64()), "sums": pa.array([padded], pa.list_(pa.int64()))})
        release_memory()

    return run


def _refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round; entries that no vector has stay."""
    parts = len(books.entries)
    width = max(books.bounds[k + 1] - books.bounds[k] for k in range(parts))
    sums = vectors.mapInArrow(_sums(books, parts), "entry int, limb int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    entries = [list(p) for p in books.entries]
    found: dict[int, list] = {}
    # One row for each entry and limb: 1024, of the largest finite doubles 18 times as many.
    for row in sums.groupBy("entry", "limb").agg(F.sum("n").alias("n"), *added).collect():
        n, totals = found.setdefault(row["entry"], [0, [0] * width])
        found[row["entry"]] = [n + row["n"], [t + (int(row[f"s{i}"]) << _LIMB * row["limb"]) for i, t in enumerate(totals)]]
    for key, (n, totals) in found.items():
        k, e = key >> 16, key & 0xFFFF
        entries[k][e] = tuple(t // n for t in totals[: books.bounds[k + 1] - books.bounds[k]])
    return Codebooks(tuple(tuple(p) for p in entries), books.bounds)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of vectors (vec_id, vector: usable doubles): the smallest ids to begin with, then so many rounds over all rows.

    Of a repeated id, the row with the smaller vector comes first; null ids come last. None for an empty table.
    """
    first = vectors.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    first = [r for r in first if len(r["vector"]) == width]
    bounds = tuple(width * k // parts for k in range(parts + 1))
    x = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), width)).tolist()
    books = Codebooks(tuple(tuple(tuple(v[bounds[k] : bounds[k + 1]]) for v in x) for k in range(parts)), bounds)
    same = vectors.where(F.size("vector") == width).select("vector")
    for _ in range(rounds if width else 0):
        books = _refined(same, books)
    return books


def _codes(books: Codebooks):
    def run(batches):
        entries = books.arrays()
        for batch in batches:
            for a, x in _matrices(batch.column(0), books.bounds[-1]):
                codes, errors = np.zeros((len(x), len(entries)), np.uint8), np.zeros(len(x), object)
                for k, own in enumerate(entries):
                    at, least = nearest(x[:, books.bounds[k] : books.bounds[k + 1]], own)
                    codes[:, k] = at
                    errors += least.astype(object)
                rest = [c.slice(a, len(x)) for c in batch.columns[1:]]
                made = [pa.array([c.tobytes().hex() for c in codes]), pa.array([min(e, MOST) for e in errors.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest, *made], [*batch.schema.names[1:], "code", "error"])
        release_memory()

    return run


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped, so are vectors of
    another length than that of the smallest id (its length need not be a multiple of parts: part k
    begins at length * k / parts, rounded down). Repeated rows each get their code; null ids and null
    labels are values like others; sums beyond a long are its largest. An empty table, or one without
    a usable vector, gives no rows. Other columns are ignored, whatever their names. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for a part: entries must be 1 to 256")
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    rows = rows.where(_usable(F.col("vector")))
    books = fit(rows, parts, entries, rounds)
    width = books.bounds[-1] if books else -1
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.where(F.size("vector") == width).select("vector", "vec_id", "label")
    coded = coded.mapInArrow(_codes(books or Codebooks((), (0,))), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")
    coded = checkpointed(coded)
    # One label can have a third of all rows: sums are copied to SALTS tasks, rows dealt to them.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error"))
    sums = sums.select(F.col("label").alias("__label"), "label_error", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("__salt"))
    dealt = coded.withColumn("__own", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def decode(code: str, books: Codebooks) -> list[int]:
    """The integer vector that a code stands for."""
    return [v for k, e in enumerate(bytes.fromhex(code)) for v in books.entries[k][e]]


def brute_force(rows: Sequence[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, dict]:
    """Codebooks and {vec_id: (code, error)} of (vec_id, vector), as a plain loop gives them; for tests."""
    ints = [(i, [math.floor(SCALE * x) if abs(x) < 2**900 else int(x) * SCALE for x in v]) for i, v in sorted(rows)]
    width = len(ints[0][1])
    bounds = tuple(width * k // parts for k in range(parts + 1))
    cut = lambda v, k: tuple(v[bounds[k] : bounds[k + 1]])
    books = [[cut(v, k) for _, v in ints[:entries]] for k in range(parts)]

    def assign(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, k), e, strict=True)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        new = []
        for k in range(parts):
            got: dict[int, list] = {}
            for _, v in ints:
                got.setdefault(assign(v, k)[1], []).append(cut(v, k))
            new.append([tuple(sum(c) // len(got[i]) for c in zip(*got[i], strict=True)) if i in got else e for i, e in enumerate(books[k])])
        books = new
    final = {}
    for i, v in ints:
        found = [assign(v, k) for k in range(parts)]
        final[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return Codebooks(tuple(map(tuple, books)), bounds), final
