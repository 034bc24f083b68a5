"""Approximate nearest neighbours by inverted multi-index.

Vectors are cut in two halves; each half has its own k centroids, so k x k cells share 2k centroids; k
follows the square root of the number of vectors, between bounds. A query ranks the cells by the sum of its inner products with the two centroids, best first, by
walking the grid of sorted centroids with a heap, and stops when the cells it has taken hold enough
candidates. All candidates are reranked by the exact inner product in double precision.

How many candidates are enough is calibrated: on a bounded sample the share of all vectors that a
query must scan for a recall of TARGET against brute force is measured, and applies to the table.
Centroids are fitted on the same sample; every vector is indexed.

Queries are compared in blocks: a block of cells, or a part of a hot cell, with the queries that have
cells in it. What a query tells a block is the score of the last cell that it takes, so a row is small
whatever it scans. A block with many queries is copied for each BLOCK_QUERIES of them, others are not.
Equal vectors are held once, with as many of their smallest ids as can be neighbours, which is exact for
the nearest neighbours asked for: a large group of copies costs one vector.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Centroids of a half: the square root of the number of vectors over 8, at least and at most.
CENTROIDS = (32, 256)
#: Vectors that centroids are fitted and calibrated on at most, and queries of the calibration.
SAMPLE, SAMPLE_QUERIES = 12_000, 300
TARGET = 0.95
#: Vectors of a block, and queries that a copy of a block meets, at most on average.
BLOCK_VECTORS, BLOCK_QUERIES, QUERIES_AT_ONCE = 8192, 32768, 128


def centroids_for(n: int) -> int:
    return max(CENTROIDS[0], min(CENTROIDS[1], int(n**0.5 / 8)))


@dataclass(frozen=True)
class Index:
    left: np.ndarray
    right: np.ndarray
    share: float  # of all vectors that a query scans

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest centroid of each half."""
        cut = self.left.shape[1]
        near = [np.argmin((c * c).sum(axis=1)[None, :] - 2 * (h @ c.T), axis=1) for h, c in ((x[:, :cut], self.left), (x[:, cut:], self.right))]
        return near[0] * len(self.right) + near[1]

    def scores(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Summed inner products of queries with the centroids of cells."""
        cut = self.left.shape[1]
        i, j = np.divmod(cells, len(self.right))
        return (queries[:, :cut] @ self.left.T)[:, i] + (queries[:, cut:] @ self.right.T)[:, j]

    def probe(self, query: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
        """Cells in order of summed inner products, until they hold as many vectors as wanted."""
        cut = self.left.shape[1]
        a, b = self.left @ query[:cut], self.right @ query[cut:]
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, rows, columns = a[i_of].tolist(), b[j_of].tolist(), (i_of * len(self.right)).tolist(), j_of.tolist()
        # A row's next cell is offered when the one before it is taken, a new row when the one above begins.
        heap, taken, held = [(-(a[0] + b[0]), 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] + columns[j]
            if sizes[cell]:
                taken.append(cell)
                held += int(sizes[cell])
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return taken


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds; a centroid without vectors moves to the worst served one."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(np.unique(x, axis=0))))
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        d = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        if (n == 0).any():
            worst = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(axis=1)), kind="stable")
            for lost, at in zip(np.flatnonzero(n == 0), worst, strict=False):
                sums[lost], n[lost] = x[at], 1
        c = sums / n[:, None]
    return c


def build(sample: np.ndarray, neighbours: int, centroids: int = CENTROIDS[0], target: float = TARGET, queries: int = SAMPLE_QUERIES, seed: int = 0) -> Index:
    """Fits the centroids and calibrates the share to scan on a sample of vectors."""
    if not len(sample):
        return Index(np.zeros((1, 1)), np.zeros((1, 0)), 1.0)
    cut = (sample.shape[1] + 1) // 2
    index = Index(_means(sample[:, :cut], centroids, seed), _means(sample[:, cut:], centroids, seed + 1), 1.0)
    n = len(sample)
    if n <= 4 * neighbours:
        return index
    cells = index.assign(sample)
    sizes = np.bincount(cells, minlength=index.cells)
    asked = np.random.default_rng(seed + 2).permutation(n)[:queries]
    scores = sample[asked] @ sample.T
    needed = []
    for row, q in zip(scores, asked, strict=True):
        row[q] = -np.inf
        best = np.argpartition(-row, neighbours)[:neighbours]
        order = np.argsort(-index.scores(sample[q][None], np.arange(index.cells))[0], kind="stable")  # as the heap gives them
        before = np.zeros(index.cells)
        before[order] = np.cumsum(sizes[order])
        needed.append(before[cells[best]])
    # Neighbours whose cell is complete once the share is scanned are found.
    return Index(index.left, index.right, min(1.0, float(np.quantile(np.concatenate(needed), target)) / n))


def _valid(vector: str) -> F.Column:
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite & F.exists(v, lambda x: x != 0)


def nearest(
    df: DataFrame,
    neighbours: int = 20,
    query_every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    centroids: int | None = None,
    target: float = TARGET,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for every query_every-th id.

    Vectors that are null or zero, or hold null, NaN or infinite components, take no part, nor do rows
    with a null id or a dimension other than the commonest. Rows of equal id and vector count once; a row that shares
    a query's id is never its neighbour. Ties go to the smaller id; an empty table gives no rows; other
    columns of df are ignored. An id with several vectors asks with the one whose bytes are the least. Where
    the sample has 4 * neighbours vectors or fewer nothing is calibrated and all cells are scanned.
    """
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(_valid("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not size:
        return df.sparkSession.createDataFrame([], out)
    total, width = size[0]["count"], size[0]["n"]
    rows = rows.where(F.size("v") == width)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * sample / total))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    index = build(drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width), neighbours, centroids or centroids_for(total), target)

    def packed(batches):
        """Vectors as bytes: short keys to group and shuffle by. Zeros get one sign."""
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    rows = rows.mapInArrow(packed, "vec_id long, v binary")
    # Equal vectors once, with the ids that can be neighbours: a query may itself be one of the smallest.
    # The limit on the rank is applied before the shuffle too.
    held = neighbours + 1
    ranked = rows.withColumn("k", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= held)
    once = ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def placed_in_cells(batches):
        for b in batches:
            cells = index.assign(_unpacked(b.column(0), width)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int32))], ["v", "ids", "cell"])

    vectors = checkpointed(once.mapInArrow(placed_in_cells, "v binary, ids array<long>, cell int"))
    # A table of k x k rows, 65,536 at most.
    sizes = np.zeros(index.cells, np.int64)
    for r in vectors.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    n_vectors = int(sizes.sum())
    wanted = max(held, index.share * n_vectors)
    # Cells are dealt to blocks in runs of about equal size; a cell over the size has parts of its own.
    parts = np.maximum(1, -(-sizes // BLOCK_VECTORS))
    first = np.zeros(index.cells, np.int64)
    load, block = 0, 0
    for c in range(index.cells):
        if parts[c] > 1 or load + sizes[c] > BLOCK_VECTORS and load:
            block, load = block + bool(load), 0
        first[c] = block
        if parts[c] > 1:
            block, load = block + int(parts[c]), 0
        else:
            load += int(sizes[c])
    # One row a cell.
    places = df.sparkSession.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(index.cells) if sizes[c]], "cell int, first int, parts int")
    placed = vectors.join(F.broadcast(places), "cell").select((F.col("first") + F.pmod(F.xxhash64("v"), "parts")).cast("int").alias("block"), "cell", "v", "ids")

    def probes(batches):
        """Of each query, the blocks that hold its cells, and the score of its last cell."""
        for b in batches:
            asks, blocks, lasts = [], [], []
            for q, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw)
                cells = np.array(index.probe(v, sizes, wanted))
                runs = np.unique(np.repeat(first[cells], parts[cells]) + np.arange(parts[cells].sum()) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells]))
                asks.append(np.full(len(runs), q))
                blocks.append(runs)
                lasts.append(np.full(len(runs), index.scores(v[None], cells)[0].min()))
            if asks:
                cols = (pa.array(np.concatenate(c), t) for c, t in zip((asks, blocks, lasts), (pa.int64(), pa.int32(), pa.float64()), strict=True))
                yield pa.RecordBatch.from_arrays(list(cols), ["query_id", "block", "last"])

    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = checkpointed(queries.repartition(max(1, n_vectors // BLOCK_VECTORS), "vec_id").mapInArrow(probes, "query_id long, block int, last double"))
    # One row for each BLOCK_VECTORS vectors, about.
    copies = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("copies"))
    dealt = placed.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = asked.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("query_id"), "copies").cast("int"))
    asked = asked.join(queries.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "block", "copy", "last", "v")

    def rerank(base: pa.Table, qs: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if base.num_rows and qs.num_rows:
            cells = base.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            x, ids = _unpacked(base.column("v"), width)[order], base.column("ids").take(pa.array(order)).to_pylist()
            names, starts = np.unique(cells[order], return_index=True)
            ends = np.append(starts[1:], len(x))
            for at in range(0, qs.num_rows, QUERIES_AT_ONCE):
                part = qs.slice(at, QUERIES_AT_ONCE)
                q, who = _unpacked(part.column("v"), width), part.column("query_id").to_pylist()
                last = part.column("last").to_numpy()
                asks = index.scores(q, names.astype(np.int64)) >= (last - 1e-9 * np.maximum(1.0, np.abs(last)))[:, None]
                scores = np.full((len(who), len(x)), -np.inf)
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    mine = np.flatnonzero(asks[:, k])
                    scores[mine, a:b] = q[mine] @ x[a:b].T
                cuts = np.partition(scores, len(x) - held, axis=1)[:, len(x) - held] if len(x) > held else np.full(len(who), -np.inf)
                for i, cut in enumerate(cuts.tolist()):
                    # Rounding of the matrix product may swap neighbours: those within it are all kept.
                    near = np.flatnonzero((scores[i] >= cut - 1e-9 * max(1.0, abs(cut))) & (scores[i] > -np.inf))
                    own = [(-float(np.dot(x[k], q[i])), v) for k in near.tolist() for v in ids[k] if v != who[i]]
                    found += [(who[i], v, -s) for s, v in sorted(own)[:neighbours]]
        cols = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    pairs = dealt.groupBy("block", "copy").cogroup(asked.groupBy("block", "copy")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)
