"""Geometry as Column expressions. A polygon is array<struct<x: double, y: double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import EPS, clamp, safe_divide, truncate


def point(x, y) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Clockwise from the top left, with the origin at the top left."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def from_pairs(points: Column) -> Column:
    """array<array<double>> to a polygon."""
    return F.transform(points, lambda p: point(p[0], p[1]))


def flatten_polygon(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, lambda p: F.array(p["x"], p["y"])))


def unflatten_polygon(flat: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.floor(F.size(flat) / 2).cast("int")), lambda i: point(F.element_at(flat, i * 2 - 1), F.element_at(flat, i * 2)))


def truncate_polygon(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: point(truncate(p["x"]), truncate(p["y"])))


def _edges(polygon: Column) -> Column:
    """Each point with the next one around."""
    shifted = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(polygon: Column) -> Column:
    terms = F.transform(_edges(polygon), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def area(polygon: Column) -> Column:
    """Shoelace area; 0 for fewer than 3 points."""
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(polygon)))


def perimeter(polygon: Column) -> Column:
    return F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting. Left and top borders are inside, right and bottom ones outside."""
    crossed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
        x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], 1.0).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    )
    return F.size(F.filter(_edges(polygon), crossed)) % 2 == 1


def bounds(polygon: Column) -> Column:
    """struct<x0, y0, x1, y1> of the axis-aligned bounding box."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_box(polygon: Column) -> Column:
    """Whether a polygon is an axis-aligned box with area, from its top left corner on clockwise."""
    p = lambda i, a: polygon[i][a]
    return (F.size(polygon) == 4) & (p(0, "x") == p(3, "x")) & (p(1, "x") == p(2, "x")) & (p(0, "y") == p(1, "y")) & (p(2, "y") == p(3, "y")) & (p(0, "x") < p(1, "x")) & (p(0, "y") < p(2, "y"))


def box_intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def covered_area(boxes: Column) -> Column:
    """Area of the union of an array of boxes: strips between neighbouring x borders, intervals of y merged in each."""
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["x0"], b["x1"])))))

    def strip(i: Column) -> Column:
        left, right = F.element_at(xs, i), F.element_at(xs, i + 1)
        spans = F.array_sort(F.transform(F.filter(boxes, lambda b: (b["x0"] <= left) & (b["x1"] >= right)), lambda b: F.struct(b["y0"].alias("a"), b["y1"].alias("b"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
        merge = lambda s, y: F.struct((s["sum"] + F.greatest(F.lit(0.0), y["b"] - F.greatest(y["a"], s["end"]))).alias("sum"), F.greatest(s["end"], y["b"]).alias("end"))
        return (right - left) * F.aggregate(spans, start, merge, lambda s: s["sum"])

    strips = F.transform(F.sequence(F.lit(1), F.size(xs) - 1), strip)
    return F.when(F.size(boxes) == 0, F.lit(0.0)).otherwise(F.aggregate(strips, F.lit(0.0), lambda s, x: s + x))


def union_area(a: Column, b: Column, both: Column) -> Column:
    return a + b - both


def box_iou(a: Column, b: Column) -> Column:
    both = box_intersection(a, b)
    return safe_divide(both, union_area(box_area(a), box_area(b), both))


def overshoot(polygon: Column, width: Column, height: Column) -> Column:
    """Pixels by which a polygon leaves its image."""
    b = bounds(polygon)
    return F.greatest(F.lit(0.0), -b["x0"], -b["y0"], b["x1"] - (width - 1), b["y1"] - (height - 1))


def apply_homography(m: Column, x: Column, y: Column) -> Column:
    """m is a row-major array of 9."""
    w = m[6] * x + m[7] * y + m[8]
    return point((m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w)


def crop_box(width: Column, height: Column, target: int) -> Column:
    """The place of an image scaled to fit a square of target pixels, padded around its centre."""
    longest = F.greatest(width, height)
    w, h = truncate(width * target / longest), truncate(height * target / longest)
    return F.struct(F.floor((target - w) / 2).cast("double").alias("x"), F.floor((target - h) / 2).cast("double").alias("y"), w.alias("w"), h.alias("h"))


def inverse_matrix(width: Column, height: Column, target: int) -> Column:
    """Row-major matrix from padded map pixels back to original pixels."""
    c = crop_box(width, height, target)
    sx, sy, zero, one = width / c["w"], height / c["h"], F.lit(0.0), F.lit(1.0)
    return F.array(sx, zero, -c["x"] * sx, zero, sy, -c["y"] * sy, zero, zero, one)


def clamp_point(p: Column, width: Column, height: Column) -> Column:
    return point(clamp(p["x"], 0.0, width - 1), clamp(p["y"], 0.0, height - 1))


def aspect_ratio_of_box(w: Column, h: Column) -> Column:
    """Of an axis-aligned box under the hull rule: the first hull edge, from the top left, is the base."""
    return F.least(F.lit(100.0), h / (w + EPS))


def text_length(aspect: Column) -> Column:
    return F.least(F.rint(0.5 + F.greatest(aspect, 1.0 / (aspect + EPS))), F.lit(100.0)).cast("int")


def false_positive_length(aspect: Column) -> Column:
    return F.least(F.rint(0.5 + 1.0 / (EPS + aspect)), F.lit(100.0)).cast("int")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def character_centres(polygon: Column, length: Column) -> Column:
    """Pseudo-character centres of a polygon: array<struct<x, y>>.

    The first half of the points is the top line, the rest the bottom one reversed. Each section of a
    line is cut in length parts, inner points truncated; a centre is the mean of its four corners.
    """
    def of_lines(s: Column) -> Column:
        half, n = s["half"], s["n"]

        def corner(j: Column) -> Column:
            section, part = F.call_function("div", j, n).cast("int"), j % n

            def along(line: Column, axis: str) -> Column:
                start, end = F.element_at(line, section + 1)[axis], F.element_at(line, F.least(section + 2, half))[axis]
                return F.when(part == 0, start).otherwise(truncate(start + (end - start) / n * part))

            return F.struct(along(s["top"], "x").alias("tx"), along(s["top"], "y").alias("ty"), along(s["bottom"], "x").alias("bx"), along(s["bottom"], "y").alias("by"))

        corners = F.transform(F.sequence(F.lit(0), (half - 1) * n), corner)
        each = half - 1  # corners a character

        def of_corners(c: Column) -> Column:
            def centre(i: Column) -> Column:
                a, b = F.element_at(c, i * each + 1), F.element_at(c, (i + 1) * each + 1)
                return point((a["tx"] + b["tx"] + a["bx"] + b["bx"]) / 4, (a["ty"] + b["ty"] + a["by"] + b["by"]) / 4)

            return F.transform(F.sequence(F.lit(0), n - 1), centre)

        return _let(corners, of_corners)

    half = F.floor(F.size(polygon) / 2).cast("int")
    lines = F.struct(
        half.alias("half"), length.cast("int").alias("n"), F.slice(polygon, 1, half).alias("top"), F.reverse(F.slice(polygon, half + 1, F.size(polygon))).alias("bottom")
    )
    return _let(lines, of_lines)


def box_centres(x0: Column, x1: Column, length: Column) -> Column:
    """x of the character_centres() of an axis-aligned box: the middles of equal parts, inner borders truncated."""
    border = lambda j: F.when(j == 0, x0).when(j == length, x1).otherwise(truncate(x0 + (x1 - x0) / length * j))
    middle = lambda i: (border(i) + border(i + 1) + border(i) + border(i + 1)) / 4
    return F.transform(F.sequence(F.lit(0), length - 1), middle)


def quad_centres(quad: Column, length: Column, vertical: Column) -> Column:
    """Centres of a quadrilateral: equal steps between the middles of its two short sides."""
    p = lambda i: quad[i]
    mid = lambda a, b: point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    start = F.when(vertical, mid(p(0), p(1))).otherwise(mid(p(0), p(3)))
    end = F.when(vertical, mid(p(3), p(2))).otherwise(mid(p(1), p(2)))
    share = lambda c: (c + 0.5) / length
    return F.transform(F.sequence(F.lit(0), length - 1), lambda c: point(start["x"] + (end["x"] - start["x"]) * share(c), start["y"] + (end["y"] - start["y"]) * share(c)))


def quad_aspect_ratio(quad: Column) -> Column:
    """Mean horizontal side by mean vertical side, 100 at most."""
    side = lambda a, b: F.hypot(quad[b]["x"] - quad[a]["x"], quad[b]["y"] - quad[a]["y"])
    return F.least(F.lit(100.0), (side(0, 1) + side(3, 2)) / (side(0, 3) + side(1, 2) + EPS))


def quad_from_ltrb(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.array(left, top, right, top, right, bottom, left, bottom)
