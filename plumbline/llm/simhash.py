"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits. Two that differ in 4 bits or fewer differ in at most one bit of one of
three slices (22, 21 and 21 bits). Each slice, zero-extended to 23 bits, is covered by the perfect
binary Golay code: 4096 anchors with covering radius 3. A fingerprint is at home at the one anchor
within 3 of its slice and visits every anchor within 3 + 1, about five. If slices x and y differ in
one bit at most, y visits x's home anchor, so comparing homes with visitors at each anchor over the
full 64 bits finds every pair, and nothing is capped.

That compares 0.4 % of all pairs, so from FINE_FROM fingerprints on anchors are pairs of codewords of
two slices. The slice that differs most holds at least a third of the bits, so the other two differ in
two bits at most: a fingerprint is at home at one of 4096^2 anchors for each two slices and visits
those that are within 3 and 3 of theirs but for two bits in all, about 61. That is some 180 short rows
a fingerprint whatever their number, and 0.001 % of all pairs.

Only distinct fingerprints are compared. A pair counts where the smaller fingerprint is at home, in
the first slice (or two slices) that qualifies, hence once. What a task emits is a spanning forest of the links it
found, not the pairs: a group of n near copies costs about n rows. An anchor with many homes is
split by salt, homes once and visitors to each part, and visitors stream past the homes, so memory
is bounded by HOMES x VISITORS. Components come from contraction in DataFrames, in rounds whose number grows with
the logarithm of the nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.split import components as graph_components
from .common import checkpointed, joined_by_hot_key, map_text, release_memory, text_or_empty, unused

MAX_BITS, SHINGLE_WORDS = 4, 4
#: (shift, bits) of the slices.
SLICES = ((0, 22), (22, 21), (43, 21))
#: Homes that one part of an anchor holds and visitors that are compared at a time.
HOMES, VISITORS = 2048, 2048
#: Distinct fingerprints from which two slices make an anchor: both coverings cost about the same there.
FINE_FROM = 1 << 25
_GENERATOR = 0b101011100011  # of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle_words])).tolist()
    ends = (ends[shingle_words - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, unsigned; 0 for none."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for a in range(0, n, 65536):
        counts += np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text, unsigned; 0 if it has no words."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(df: DataFrame, shingle_words: int = SHINGLE_WORDS, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)]

    return map_text(df, make, "fp long", text, keep)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, _GENERATOR << (bit - 11), 0)
    return x


@dataclass(frozen=True)
class Cover:
    """Which slices make an anchor, and by how many bits in all a visitor may be beyond their radius."""

    groups: tuple[tuple[int, ...], ...]
    slack: int

    @property
    def most_bits(self) -> int:
        """The most differing bits of which no pair is lost."""
        return 5 if self is COARSE else 4

    def key(self, k: int, anchors: list[np.ndarray]) -> np.ndarray:
        key = np.full(len(anchors[0]), k, np.int64)
        for a in anchors:
            key = key << 23 | a
        return key

    def masks(self, k: int) -> list[np.uint64]:
        """The bits of the groups up to and with group k."""
        return [np.uint64(sum(((1 << SLICES[i][1]) - 1) << SLICES[i][0] for i in g)) for g in self.groups[: k + 1]]


COARSE, FINE = Cover(((0,), (1,), (2,)), 1), Cover(((0, 1), (0, 2), (1, 2)), 2)


@cache
def _covering(radius: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of weight radius or less by syndrome, lightest first: starts, patterns, weights."""
    bits = np.int64(1) << np.arange(23)
    layers = [np.zeros(1, np.int64)]
    for _ in range(radius):
        layers.append(np.unique((layers[-1][:, None] ^ bits[None, :])[(layers[-1][:, None] & bits[None, :]) == 0]))
    words = np.concatenate(layers)
    weights = np.bitwise_count(words)
    order = np.lexsort((weights, syndromes := _syndrome(words)))
    starts = np.searchsorted(syndromes[order], np.arange(2049))
    return starts, words[order], weights[order]


def _every(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run and what place, for runs of n places from starts."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def anchors(slices: np.ndarray, slack: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit words: which word, the anchor, and by how many bits it is beyond the radius (0 at home)."""
    starts, words, weights = _covering(3 + slack)
    s = _syndrome(slices.astype(np.int64))
    which, at = _every(starts[s], starts[s + 1] - starts[s])
    return which, slices[which] ^ words[at], np.maximum(weights[at].astype(np.int64) - 3, 0)


def _anchors_of(fp: np.ndarray, cover: Cover, k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints: which one, the anchor of group k, and whether it is at home there."""
    which, found, beyond = np.arange(len(fp)), [], np.zeros(len(fp), np.int64)
    for i in cover.groups[k]:
        shift, bits = SLICES[i]
        own, anchor, more = anchors((fp >> shift) & ((1 << bits) - 1), slack)
        n = np.bincount(own, minlength=len(fp))
        row, at = _every((np.cumsum(n) - n)[which], n[which])
        total = beyond[row] + more[at]
        keep = total <= slack
        row, at, beyond = row[keep], at[keep], total[keep]
        which, found = which[row], [*(f[row] for f in found), anchor[at]]
    return which, cover.key(k, found), beyond == 0


def _visits(cover: Cover, slack: int):
    """Rows (anchor, home, fp) of the anchors of fingerprints; with no slack, their homes."""

    def run(batches):
        kind = np.int32 if cover is COARSE else np.int64
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fps), 1 << 12):
                fp = fps[a : a + (1 << 12)]
                for k in range(len(cover.groups)):
                    which, anchor, home = _anchors_of(fp, cover, k, slack)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(kind)), pa.array(home), pa.array(fp[which])], ["anchor", "home", "fp"])
        release_memory()

    return run


def _forest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A smallest home index for each home and visitor of the bipartite links (homes x visitors)."""
    big = hits.shape[0]
    homes = np.arange(big)
    while True:
        visitors = np.where(hits, homes[:, None], big).min(axis=0, initial=big)
        least = np.minimum(homes, np.where(hits, visitors[None, :], big).min(axis=1, initial=big))
        least = np.minimum(least, least[least])
        if (least == homes).all():
            return homes, visitors
        homes = least


def _links(homes: np.ndarray, visitors: np.ndarray, masks: list[np.uint64], slack: int, max_bits: int):
    """Links of homes with visitors at an anchor, as pairs that span the same components; masks are the bits of its group, last, and those before."""
    for a in range(0, len(homes), 256):
        h = homes[a : a + 256]
        hits = h[:, None].view(np.int64) < visitors[None, :].view(np.int64)
        x = h[:, None] ^ visitors[None, :]
        hits &= np.bitwise_count(x) <= max_bits
        rows, cols = np.nonzero(hits.any(axis=1))[0], np.nonzero(hits.any(axis=0))[0]
        if not len(rows):
            continue
        x, hits = x[np.ix_(rows, cols)], hits[np.ix_(rows, cols)]
        for mask in masks[:-1]:  # an earlier group has this pair
            hits &= np.bitwise_count(x & mask) > slack
        hits &= np.bitwise_count(x & masks[-1]) <= slack  # beyond that a pair meets by chance, and a later group has it
        near, far = _forest(hits)
        linked = far < len(rows)
        yield h[rows[far[linked]]], visitors[cols[linked]]
        moved = near != np.arange(len(rows))
        yield h[rows[near[moved]]], h[rows[moved]]


def _compare(cover: Cover, max_bits: int):
    masks = [cover.masks(k) for k in range(len(cover.groups))]
    group_bits = 23 * len(cover.groups[0])

    def run(batches):
        key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            home, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
            new = np.nonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))[0] + 1
            cuts = np.concatenate(([0], new, [len(anchor)])) if len(anchor) else [0]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := (int(anchor[a]), int(part[a]))) != key:
                    key, held = now, np.zeros(0, np.uint64)
                mine = home[a:b]
                if mine.any():  # homes of a key sort before its visitors
                    held = np.concatenate((held, fp[a:b][mine]))
                for c in range(a, b, VISITORS):
                    seen = fp[c : min(b, c + VISITORS)][~home[c : min(b, c + VISITORS)]]
                    if len(seen) and len(held):
                        out += _links(held, seen, masks[key[0] >> group_bits], cover.slack, max_bits)
            if out:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release_memory()

    return run


def spanning_links(fps: DataFrame, max_bits: int = MAX_BITS, fine_from: int = FINE_FROM) -> DataFrame:
    """Pairs (u, v) of fingerprints whose components are those of all links of max_bits or fewer.

    fps has distinct longs in its column fp, and is read more than once. Both coverings give the same
    components; from fine_from fingerprints on, the finer one is used.
    """
    if max_bits > COARSE.most_bits:
        raise ValueError(f"this covering finds up to {COARSE.most_bits} differing bits")
    cover = FINE if max_bits <= FINE.most_bits and fps.count() >= fine_from else COARSE
    kind = "int" if cover is COARSE else "long"
    visits = fps.select("fp").mapInArrow(_visits(cover, cover.slack), f"anchor {kind}, home boolean, fp long")
    homes = fps.select("fp").mapInArrow(_visits(cover, 0), f"anchor {kind}, home boolean, fp long")
    parts = homes.groupBy("anchor").agg(F.ceil(F.count("*") / HOMES).cast("int").alias("parts"))
    # A table of 3 x 4096 rows at most: the code bounds it, not the data. Of the finer anchors few have parts, but no bound says so.
    parts = F.broadcast(parts) if cover is COARSE else checkpointed(parts.where("parts > 1"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = visits.join(parts, "anchor", "inner" if cover is COARSE else "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("anchor", part.alias("part"), "home", "fp", "parts")
    # A home is also a visitor of its anchor; it is held in one part and passes all.
    roles = F.array(F.lit(True), F.lit(False))
    dealt = dealt.select("anchor", "part", F.explode(F.when(F.col("home") & (F.pmod(F.xxhash64("fp"), "parts") == F.col("part")), roles).otherwise(F.array(F.lit(False)))).alias("held"), "fp")
    sorted_parts = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("held"))
    return sorted_parts.mapInArrow(_compare(cover, max_bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v); label is the smallest node of its component."""
    return graph_components(edges, "u", "v")


def _named_components(docs: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id, n) of every distinct fingerprint of docs (doc_id, fp), with its rows."""
    first = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    labels = components(spanning_links(first.select("fp"), max_bits))
    labelled = checkpointed(first.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.col("n").alias("copies"), F.coalesce("label", "fp").alias("label")))
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return joined_by_hot_key(labelled, named, "label").select("fp", "component_id", F.col("copies").alias("n"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id reachable by links, the row's own included. A null or empty
    text has the fingerprint zero and links like any other. A null id never names a component that
    has another id. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = checkpointed(fingerprints(src, shingle_words, "text", ["doc_id"]))
    by_fp = checkpointed(_named_components(docs, max_bits))
    return joined_by_hot_key(docs, by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key(doc_id: str, text: str):
    """What a row is told from others by: its id, unless null, and a hash of its text."""
    return F.concat_ws(":", F.col(f"`{doc_id}`").cast("string"), F.xxhash64(F.col(f"`{text}`")).cast("string"))


def heads_only(df: DataFrame, docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of df for each label: that of the smallest id, then of the smallest key; null ids come last.

    docs has doc_id, __key (row_key()) and fp of every row, labels what components() gives. Of equal
    rows one stays. The texts are shuffled once, by the key of the rows that stay.
    """
    # Copies are reduced to one row before anything is joined by fp: a hot fp costs a row for each task.
    first = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")).alias("head"))
    labelled = first.join(labels, F.col("fp") == F.col("node"), "left").select("head", F.coalesce("label", "fp").alias("label"))
    key = unused(df.columns, "key")
    keys = labelled.groupBy("label").agg(F.min("head").alias("head")).select(F.col("head.__key").alias(key))
    return df.withColumn(key, row_key(doc_id, text)).join(keys, key, "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in df.columns))


def drop_near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_bits: int = MAX_BITS,
    shingle_words: int = SHINGLE_WORDS,
    overlap: bool = False,
) -> DataFrame:
    """One row of df for each component, as heads_only() says; rows with a null id link like any other.

    Without overlap, fingerprints link at max_bits or fewer differing bits. With it, links of the
    covering are candidates that an exact check follows: texts link if their sets of shingles overlap
    by 4/5 or more. Such texts often differ in more bits than a covering can bridge, so the module
    overlap adds the candidates beyond max_bits and none is lost. A null or empty text links with its
    like only; of equal rows one stays; an empty table gives no rows; all columns stay as they are.
    """
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"), row_key(doc_id, text).alias("__key"))
    if overlap:
        from .overlap import linked_sets

        docs, links = linked_sets(src, max_bits, shingle_words)
    else:
        docs = checkpointed(fingerprints(src, shingle_words, "text", ["doc_id", "__key"]))
        links = spanning_links(checkpointed(docs.select("fp").distinct()), max_bits)
    return heads_only(df, docs, components(links), doc_id, text)
