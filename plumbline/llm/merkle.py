"""Merkle manifest of a table: a tree for each group, one over the groups' roots, and a proof for each row.

Coordinate lookup proofs: a node is known by its group, level and index. A leaf's index and its
group's size say which siblings its proof needs, so leaves explode those coordinates and join the
materialised node table; the siblings found are put in order of level, concatenated and folded.

Trees are built and looked up in tiers of TIER levels. A tier's units (leaves at first, then what the
tier below made of 2^TIER of them) are gathered in blocks, each block makes its nodes, and each unit
explodes the coordinates of this tier only; what lies above is looked up once for the block and
handed down. So no node is asked for by more than 2^TIER units, a table of N rows takes about
TIER * N coordinates and not N * log N, and a group that has most rows is worked on by all tasks.
Places within a group come from a range partitioning by group and id, with the counts of each
group in each partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, discard

TIER = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    """The digest of texts, as 32 bytes: hexadecimal text would be twice as much to shuffle."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def _runs(batches):
    """Adds __part, the partition, and __at, the place in the run of equal groups that the partition has."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        groups = batch.column(0)
        if not len(groups):
            continue
        new = np.concatenate(([True], pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)))
        starts = np.nonzero(new)[0]
        at = np.arange(len(groups)) - np.repeat(starts, np.diff([*starts, len(groups)]))
        if groups[0].as_py() == last:
            at[: starts[1] if len(starts) > 1 else len(at)] += n
        last, n = groups[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], [*batch.schema.names, "__part", "__at"])


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df, whose first column is its group (a string, never null), with pos, its place in its group by order, and n, the group's size.

    Rows that are equal in order are interchangeable. Written to the shared folder.
    """
    group = df.columns[0]
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = checkpointed(ranged.mapInArrow(_runs, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, __part int, __at long"))
    counts = placed.groupBy(group, "__part").agg(F.count("*").alias("__rows"))
    # A window has a row for each partition that the group is in.
    before = F.sum("__rows").over(W.partitionBy(group).orderBy("__part")) - F.col("__rows")
    counts = counts.select(group, "__part", before.alias("__before"), F.sum("__rows").over(W.partitionBy(group)).alias("n"))
    return placed.join(counts, [group, "__part"]).withColumn("pos", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def _size(level: int | Column, n: Column) -> Column:
    """Nodes of a group of n units at a level."""
    return F.ceil(n / F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))).cast("long")


def _paired(level: Column) -> Column:
    """The nodes above: each of two, the last of one or two."""
    pairs = F.sequence(F.lit(0), _div(F.size(level) + 1, 2).cast("int") - 1)
    return F.transform(pairs, lambda i: _hash(_text(F.get(level, 2 * i)), F.coalesce(_text(F.get(level, 2 * i + 1)), F.lit(""))))


def tier_nodes(units: DataFrame) -> DataFrame:
    """The node table (g, n, level, idx, node) of a tier over units (g, n, pos, node); level 0 are the units."""
    blocks = units.groupBy("g", "n", _div(F.col("pos"), 1 << TIER).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("own"))
    blocks = blocks.select("g", "n", "block", F.col("own.node").alias("l0"))
    for level in range(TIER):
        blocks = blocks.withColumn(f"l{level + 1}", F.when(_size(level, F.col("n")) > 1, _paired(F.col(f"l{level}"))))
    levels = blocks.select("g", "n", "block", F.posexplode(F.array(*(f"l{k}" for k in range(TIER + 1)))).alias("level", "nodes"))
    nodes = levels.select("g", "n", "level", "block", F.posexplode("nodes").alias("i", "node"))  # no row of a level that is not there
    idx = F.expr(f"shiftright(block * {1 << TIER}, level)") + F.col("i")
    return checkpointed(nodes.select("g", "n", "level", idx.alias("idx"), "node"))


def tier_paths(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, pos, path) of units (g, n, pos): for each level of the tier, whether the sibling is on the left, and the sibling, null if it has none."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(TIER - 1)))
    wanted = units.select("g", "n", "pos", levels.alias("level")).where(_size(F.col("level"), F.col("n")) > 1)
    own = F.expr("shiftright(pos, level)")
    wanted = wanted.select("g", "pos", "level", own.bitwiseXOR(F.lit(1)).alias("idx"))
    found = wanted.join(nodes.where(F.col("level") < TIER).select("g", "level", "idx", "node"), ["g", "level", "idx"], "left")
    step = F.struct("level", (F.col("idx") % 2 == 0).alias("left"), "node")
    path = F.array_sort(F.collect_list(step))
    return found.groupBy("g", "pos").agg(F.transform(path, lambda s: F.struct(s["left"], s["node"])).alias("path"))


@dataclass(frozen=True)
class Forest:
    """roots: (g, root) of each group; paths: (g, pos, path, root) of each unit, up to its group's root and on along above."""

    roots: DataFrame
    paths: DataFrame


def grow(units: DataFrame, largest: int, above=None) -> Forest:
    """The trees of units (g, n, pos, node), the largest group of which has so many.

    above(roots) gives (g, path, root): what each group's paths go on with; nothing if there is no such function.
    """
    tiers = []
    while True:
        nodes = tier_nodes(units)
        tiers.append((units, nodes))
        top = F.max_by("node", "level").alias("root")
        done = nodes.where(F.col("n") <= 1 << TIER).groupBy("g").agg(top)
        roots = done if len(tiers) == 1 else roots.unionAll(done)
        if largest <= 1 << TIER:
            break
        largest = -(-largest // (1 << TIER))
        rest = nodes.where((F.col("level") == TIER) & (F.col("n") > 1 << TIER))
        units = rest.select("g", _size(TIER, F.col("n")).alias("n"), F.col("idx").alias("pos"), "node")
    roots = checkpointed(roots)
    none = F.array().cast("array<struct<left:boolean,node:binary>>")
    ends = (above(roots) if above else roots.withColumn("path", none)).select("g", F.col("path").alias("rest"), "root")
    upper = None
    for units, nodes in reversed(tiers):
        own = units.select("g", "n", "pos").join(tier_paths(units, nodes), ["g", "pos"], "left")
        own = own.select("g", "n", "pos", F.coalesce("path", none).alias("path"), _div(F.col("pos"), 1 << TIER).alias("up"))
        # The end of a group's paths goes to its one top block, below which blocks hand it down.
        handed = ends.select("g", F.lit(0).cast("long").alias("up"), "rest", "root")
        if upper is not None:
            tops = nodes.where(F.col("n") <= 1 << TIER).select("g").distinct()
            handed = handed.join(tops, "g", "left_semi").unionAll(upper.select("g", F.col("pos").alias("up"), F.col("path").alias("rest"), "root"))
        lower = checkpointed(own.join(handed, ["g", "up"]).select("g", "pos", F.concat("path", "rest").alias("path"), "root"))
        discard(nodes, upper)
        upper = lower
    return Forest(roots, upper)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    side = lambda here, node: F.when(here, node).otherwise(F.lit(""))

    def up(node: Column, step: Column) -> Column:
        other = F.coalesce(_text(step["node"]), F.lit(""))
        return _hash(side(step["left"], other), _text(node), side(~step["left"], other))

    return F.aggregate(path, leaf, up)


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "lang", counter: str = "n_chars", every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the hash of the row's fields in the given order. Trees take two nodes at a time, one
    where a level ends; a group's leaves ascend by doc_id, then by leaf, null ids first; groups ascend
    bytewise, null first, and make a tree of their own. Rows whose id's crc32 every divides are
    tampered with: their counter is one more when the proof is folded, a null counter and a null id
    change nothing. Equal rows have leaves of their own side by side. An empty table gives no rows.
    Columns that are not fields are ignored, whatever their names.
    """
    src = df.select(*(F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(fields)), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{group}`").cast("string").alias("group"))
    own = [F.col(f"f{k}") for k in range(len(fields))]
    more = [field((x.cast("decimal(38,0)") + 1).cast("decimal(38,0)") if c == counter else x) for c, x in zip(fields, own, strict=True)]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    # `-` sorts before `=`, so null is first and other groups keep their order.
    g = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-")).alias("g")
    leaves = checkpointed(src.select(g, "doc_id", _hash(*map(field, own)).alias("node"), F.when(chosen, _hash(*more)).alias("changed")))
    placed = checkpointed(numbered(leaves, ["doc_id", "node"]))
    discard(leaves)
    root = None

    def over_groups(roots: DataFrame) -> DataFrame:
        nonlocal root
        names = checkpointed(numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node")), ["name"]))
        forest = grow(names.select("g", "n", "pos", "node"), names.count())
        root = forest.roots.first()  # one row
        own = names.select("g", "pos", "name", "node").join(forest.paths.select("g", "pos", "path"), ["g", "pos"])
        return own.select(F.col("name").alias("g"), "path", F.col("node").alias("root"))

    largest = placed.agg(F.max("n")).first()[0] or 1
    forest = grow(placed.select("g", "n", "pos", "node"), largest, over_groups)
    # What rows of a group have in common reaches them by place, not by group: no task gets a whole group.
    rows = placed.join(forest.paths, ["g", "pos"])
    siblings = F.array_join(F.transform("path", lambda s: _text(s["node"])), "")
    folded = fold(F.coalesce("changed", "node"), F.col("path"))
    top = F.lit(root["root"].hex() if root else None).cast("string")
    out = rows.select("doc_id", _text(F.col("node")).alias("leaf"), _text(F.col("root")).alias("subroot"), top.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), _text(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def brute_force(rows: Sequence[tuple], every: int = 7) -> list[tuple]:
    """What manifest() gives of (doc_id, source, lang, n_chars, text), by plain loops; for tests."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(part, r)))

    def climb(nodes):
        """Root, and of each node its steps (left, right) to it."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, k in enumerate(at):
                run = level[k // 2 * 2 : k // 2 * 2 + 2]
                steps[i].append(("".join(run[: k % 2]), "".join(run[k % 2 + 1 :])))
            at = [k // 2 for k in at]
            level = [h("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        return level[0], steps

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, upper = climb([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, steps), rest in zip(trees, upper, strict=True):
        for r, path in zip(own, steps, strict=True):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % every == 0
            node = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for a, b in path + rest:
                node = h(a + node + b)
            out.append((r[0], leaf(r), subroot, root, h("".join(a + b for a, b in path + rest)), node, node == root))
    return out
