"""Character-level evaluation of detected regions against ground truth.

A ground-truth region stands for as many pseudo-characters as its shape suggests. A pair of regions
is strong if enough of the detection lies in the ground truth and it covers a character centre.
Matches are one to one, one to many and many to one; each character counts once, and each extra piece
of a split or merged region costs a granularity penalty.

Everything is a relation. Pairs come from an equi-join on the image with a bounding-box test, and all
later steps group by keys that start with the image, so the join's partitioning serves them all: one
exchange for each input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import harmonic_mean, safe_divide, truncate


@dataclass(frozen=True)
class Options:
    area_precision: float = 0.3
    recall_penalty: float = 1.0
    precision_penalty: float = 1.0
    most_boxes: int = 500


COUNTERS = ("n_gt", "n_det", "tp", "fp", "overlapped", "gran_recall", "gran_precision", "n_split", "n_merged")


def cap_boxes(boxes: DataFrame, order, most: int = 500) -> DataFrame:
    """The first boxes of each image in the given order."""
    return boxes.withColumn("__k", F.row_number().over(W.partitionBy("image").orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def box_pairs(gt: DataFrame, det: DataFrame, *more: str) -> DataFrame:
    """(image, g, d, dc, gt_length, fp_length, ap, hits) of axis-aligned boxes, all as expressions, and more columns of det.

    gt: image, g, x0, y0, x1, y1, dc; det: image, d, x0, y0, x1, y1. Areas and containment use
    truncated coordinates, lengths and centres the raw ones; hits are the covered characters. A
    don't-care region's area is without that of the ground truth in it.
    """
    t = lambda c: truncate(F.col(c))
    g = gt.select("image", "g", "dc", *(F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")))
    g = g.withColumn("gt_length", gt_length(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0")))
    g = g.withColumn("centres", G.box_centres(F.col("gx0"), F.col("gx1"), F.col("gt_length")))  # once a region, not once a pair
    d = det.select("image", "d", fp_length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("fp_length"), *(t(c).alias(f"d{c}") for c in ("x0", "y0", "x1", "y1")), *more)
    near = (F.col("gx0") < F.col("dx1") + 1) & (F.col("dx0") < F.col("gx1") + 1) & (F.col("gy0") < F.col("dy1") + 1) & (F.col("dy0") < F.col("gy1") + 1)
    box = lambda p, f: F.struct(*(f(F.col(p + c)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    gb, db = box("g", truncate), box("d", lambda c: c)
    pairs = g.join(_without_truth(g), ["image", "g"], "left").join(d, "image").where(near)
    # What ground truth leaves of the don't-care region in the detection.
    clip = lambda b: F.struct(*(f(b[k], db[k]).alias(k) for k, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))))
    lost = F.filter(F.transform(F.coalesce("truth", F.array()), clip), lambda b: (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]))
    both = F.when(F.col("dc"), G.box_intersection(gb, db) - G.covered_area(lost)).otherwise(G.box_intersection(gb, db))
    return pairs.select("image", "g", "d", "dc", "gt_length", "fp_length", safe_divide(both, G.box_area(db)).alias("ap"), box_hits().alias("hits"), *more)


def box_hits(centres: str = "centres"):
    """Which characters of a box (gx0 to gy1, gt_length, the x of its centres) a truncated box (dx0 to dy1) covers."""
    # Inner corners are truncated, the ends are not: heights differ between the first, the last and all other characters.
    n, ends = F.col("gt_length"), (F.col("gy0") + F.col("gy0") + F.col("gy1") + F.col("gy1")) / 4
    y0, y1 = truncate(F.col("gy0")), truncate(F.col("gy1"))
    holds = lambda y: (y >= F.col("dy0")) & (y < F.col("dy1"))
    first, last = (F.col("gy0") + y0 + F.col("gy1") + y1) / 4, (y0 + F.col("gy0") + y1 + F.col("gy1")) / 4
    inner, alone = holds((y0 + y0 + y1 + y1) / 4), (n == 1) & holds(ends)
    starts, stops = F.when(n == 1, alone).otherwise(holds(first)), F.when(n == 1, alone).otherwise(holds(last))
    within = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(centres, i) >= F.col("dx0")) & (F.get(centres, i) < F.col("dx1")))
    fits = lambda i: F.when(i == 0, starts).when(i == n - 1, stops).otherwise(inner)
    return F.when(starts & stops & (inner | (n <= 2)), within).when(starts | stops | inner, F.filter(within, fits)).otherwise(F.array().cast("array<int>"))


def _without_truth(g: DataFrame) -> DataFrame:
    """(image, g, truth) of don't-care regions: the parts of them that other regions cover, in truncated coordinates."""
    t = lambda p, c: truncate(F.col(f"{p}.g{c}"))
    part = F.struct(*(f(t("a", c), t("b", c)).alias(c) for c, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))))
    keep = ["image", "g", "gx0", "gy0", "gx1", "gy1"]
    a, b = g.where("dc").select(keep).alias("a"), g.where("not dc").select(keep).alias("b")
    met = a.join(b, F.col("a.image") == F.col("b.image")).select("a.image", "a.g", part.alias("part")).where("part.x0 < part.x1 and part.y0 < part.y1")
    return met.groupBy("image", "g").agg(F.collect_list("part").alias("truth"))


def prepared(regions: DataFrame, flag: str = "dc", text: str = "transcription") -> DataFrame:
    """regions with dc as evaluation takes it: the flag, or where there is none whether the text is ###; a missing text is none."""
    return regions.withColumn(flag, F.coalesce(F.col(flag), F.col(text) == "###", F.lit(False)))


def transcription_or_marks(text, length):
    """A region's text, or where it is missing a # for each of its pseudo-characters."""
    return F.coalesce(text, F.repeat(F.lit("#"), length))


def admitted(flat):
    """Whether flat coordinates make a polygon: 4 points or more, and no odd value."""
    return (F.size(flat) >= 8) & (F.size(flat) % 2 == 0)


def gt_length(w, h):
    return G.text_length(G.aspect_ratio_of_box(w, h))


def fp_length(w, h):
    return G.false_positive_length(G.aspect_ratio_of_box(w, h))


def with_relations(pairs: DataFrame, options: Options = Options(), keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """pairs with det_dc, one_to_one, one_to_many, many_to_one and matched; keys tell images apart, the one that the table is dealt by among them.

    A detection is don't-care if a don't-care region holds enough of it, alone or with others.
    """
    c = F.lit(options.area_precision)
    n = F.size("hits")
    by_g, by_d = W.partitionBy(*keys, "g"), W.partitionBy(*keys, "d")
    enough = F.col("ap").cast("float") >= c.cast("float")
    dc_sum = F.sum(F.when(F.col("dc") & (n > 0), F.col("ap")).otherwise(0.0)).over(by_d)
    p = pairs.withColumn("strong", enough & (n > 0)).withColumn("det_dc", F.max(F.col("dc") & enough).over(by_d) | (dc_sum >= c))
    p = p.withColumn("valid", ~F.col("dc") & ~F.col("det_dc"))
    count = lambda cond, w: F.sum(F.when(cond, 1).otherwise(0)).over(w)
    touching = (n > 0) & F.col("valid")
    p = p.select(
        "*",
        count(F.col("strong"), by_g).alias("__sg"),
        count(F.col("strong"), by_d).alias("__sd"),
        count(F.col("strong") & F.col("valid"), by_g).alias("__sgv"),
        count(touching, by_d).alias("__nv"),
        F.sum(F.when(touching, F.col("ap")).otherwise(0.0)).over(by_d).alias("__apv"),
    )
    p = p.select(
        *(x for x in p.columns if not x.startswith("__")),
        (F.col("valid") & F.col("strong") & (F.col("__sg") == 1) & (F.col("__sd") == 1)).alias("one_to_one"),
        (F.col("valid") & F.col("strong") & (F.col("__sgv") >= 2)).alias("one_to_many"),
        (touching & (F.col("__nv") >= 2) & (F.col("__apv") >= c)).alias("many_to_one"),
    )
    return p.withColumn("matched", F.col("one_to_one") | F.col("one_to_many") | F.col("many_to_one"))


def per_image(gt: DataFrame, det: DataFrame, pairs: DataFrame, options: Options = Options(), keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Counters and scores of each image that has a region on either side.

    gt: image, g, dc, gt_length; det: image, d, fp_length; pairs as box_pairs() gives them. The pairs
    are gone through once: sums of what they contribute are added to those of gt and det by image.
    """
    p = with_relations(pairs, options, keys)
    m = F.col("matched")
    # One row of each region or detection speaks for it; windows without an order share their sorts.
    in_g, in_d = W.partitionBy(*keys, "g"), W.partitionBy(*keys, "d")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(m, F.col("hits"))).over(in_g))))
    settled = F.max(m | F.col("det_dc")).over(in_d) & (F.col("g") == F.min("g").over(in_d))
    p = p.select(
        *keys, "matched", F.size("hits").alias("hits"), (m & (F.col("d") == F.min(F.when(m, F.col("d"))).over(in_g))).alias("head_g"), (m & (F.col("g") == F.min(F.when(m, F.col("g"))).over(in_d))).alias("head_d"),
        covered.alias("covered"), F.sum(m.cast("int")).over(in_g).alias("pieces_g"), F.sum(m.cast("int")).over(in_d).alias("pieces_d"), settled.alias("settled"), "fp_length",
    )
    zero = F.lit(0).cast("long")
    when = lambda cond, value: F.when(cond, value).otherwise(0).cast("long")
    parts = {
        "n_gt": zero, "tp": when(F.col("head_g"), F.col("covered")), "hits": when(m, F.col("hits")), "fp": -when(F.col("settled"), F.col("fp_length")),
        "extra_g": when(m, 1) - when(F.col("head_g"), 1), "extra_d": when(m, 1) - when(F.col("head_d"), 1),
        "n_split": when(F.col("head_g") & (F.col("pieces_g") > 1), 1), "n_merged": when(F.col("head_d") & (F.col("pieces_d") > 1), 1),
    }
    only = lambda df, name, value: df.select(*keys, *((value.cast("long") if n == name else zero).alias(n) for n in parts))
    rows = p.select(*keys, *(v.alias(n) for n, v in parts.items()))
    rows = rows.unionAll(only(gt, "n_gt", F.when(F.col("dc"), 0).otherwise(F.col("gt_length")))).unionAll(only(det, "fp", F.col("fp_length")))
    out = rows.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in parts))
    out = out.withColumn("overlapped", F.col("hits") - F.col("tp"))
    out = out.select(
        *keys, "n_gt", (F.col("tp") + F.col("overlapped") + F.col("fp")).alias("n_det"), "tp", "fp", "overlapped",
        (F.col("extra_g") * options.recall_penalty).alias("gran_recall"), (F.col("extra_d") * options.precision_penalty).alias("gran_precision"), "n_split", "n_merged",
    )
    return with_scores(out)


def with_scores(counters: DataFrame) -> DataFrame:
    """recall, precision and hmean from summed counters; zero denominators give 0."""
    gain = lambda p: F.greatest(F.lit(0.0), F.col("tp") - F.col(p))
    scored = counters.withColumn("recall", safe_divide(gain("gran_recall"), F.col("n_gt"))).withColumn("precision", safe_divide(gain("gran_precision"), F.col("n_det")))
    return scored.withColumn("hmean", harmonic_mean(F.col("recall"), F.col("precision")))


def evaluate_boxes(gt: DataFrame, det: DataFrame, options: Options = Options()) -> DataFrame:
    """per_image() of axis-aligned boxes (see box_pairs)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return per_image(gt.withColumn("gt_length", gt_length(w, h)), det.withColumn("fp_length", fp_length(w, h)), box_pairs(gt, det), options)


def sweep_boxes(gt: DataFrame, det: DataFrame, score: str, thresholds: list[float], options: Options = Options()) -> DataFrame:
    """per_image() at each threshold of the score: (threshold, image, ...). Boxes meet once, thresholds are dealt to their pairs."""
    every, reached = F.array(*map(F.lit, thresholds)), F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t)
    # The threshold is a key of its own beside the image: pairs stay where the join put them.
    at = lambda df, which: df.withColumn("threshold", F.explode(which))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pairs = at(box_pairs(gt, det, score), reached).drop(score)
    per = per_image(at(gt.withColumn("gt_length", gt_length(w, h)), every), at(det.withColumn("fp_length", fp_length(w, h)), reached), pairs, options, ("threshold", "image"))
    return per


def macro(per: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Means of the per-image scores; an image of images without a row counts as 0, 0, 0."""
    rows = per if images is None else images.join(per, "image", "left")
    return rows.agg(F.count("*").alias("images"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"macro_{c}") for c in ("recall", "precision", "hmean")))


def total(per: DataFrame, *keys: str) -> DataFrame:
    """Global scores: counters summed, then scored once."""
    return with_scores(per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS)))


def report(per: DataFrame, *keys: str) -> DataFrame:
    """Macro and global scores and counters of each group."""
    names = ("recall", "precision", "hmean")
    grouped = per.groupBy(*keys).agg(F.count("*").alias("images"), *(F.avg(c).alias(f"macro_{c}") for c in names), *(F.sum(c).alias(c) for c in COUNTERS))
    scored = with_scores(grouped)
    return scored.select(*keys, "images", *(f"macro_{c}" for c in names), *(F.col(c).alias(f"global_{c}") for c in names), *COUNTERS)


def match_results(related: DataFrame) -> DataFrame:
    """(image, relation, gt_ids, det_ids) of every match in the pairs of with_relations(), ids ascending."""
    one = related.where("one_to_one").select("image", F.lit("one-to-one").alias("relation"), F.array("g").alias("gt_ids"), F.array("d").alias("det_ids"))
    split = related.where("one_to_many").groupBy("image", "g").agg(F.sort_array(F.collect_list("d")).alias("det_ids"))
    merged = related.where("many_to_one").groupBy("image", "d").agg(F.sort_array(F.collect_list("g")).alias("gt_ids"))
    many = split.select("image", F.lit("one-to-many").alias("relation"), F.array("g").alias("gt_ids"), "det_ids")
    return one.unionByName(many).unionByName(merged.select("image", F.lit("many-to-one").alias("relation"), "gt_ids", F.array("d").alias("det_ids")))


def scale_wise(gt: DataFrame, det: DataFrame, sizes: DataFrame, bins: list[tuple[float, float]], options: Options = Options()) -> DataFrame:
    """Global scores by size of the ground truth: other regions are don't-care in each bin.

    A region is in a bin if its height over the image's longer side (sizes: image, longest) is in
    [low, high). All bins are evaluated in one pass, the bin being a part of the image key.
    """
    scaled = gt.join(sizes, "image").withColumn("scale", (F.col("y1") - F.col("y0")) / F.col("longest"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high) in enumerate(bins))))
    key = F.struct(F.col("b.bin").alias("bin"), F.col("image").alias("id"))
    outside = ~((F.col("scale") >= F.col("b.low")) & (F.col("scale") < F.col("b.high")))
    g = scaled.withColumn("b", each).select(key.alias("image"), "g", "x0", "y0", "x1", "y1", (F.col("dc") | outside).alias("dc"))
    d = det.withColumn("b", each).select(key.alias("image"), "d", "x0", "y0", "x1", "y1")
    return total(evaluate_boxes(g, d, options).withColumn("bin", F.col("image.bin")), "bin")
