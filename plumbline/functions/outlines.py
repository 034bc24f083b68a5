"""Outlines of bitmap regions, their simplification, and polygons moved out or in with round corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .polygons import POLYGON, _alike, _points, signed_area

#: Neighbours clockwise from the right, rows growing downwards: (dy, dx).
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
_WAY = {d: k for k, d in enumerate(_AROUND)}
#: How far an arc's chords may be from it.
ARC_TOLERANCE = 0.25
#: Pairs of edges, and pixels of polygons, that are worked on at once.
PAIRS, PIXELS = 1 << 18, 1 << 18


def _turns() -> tuple[bytes, bytes, bytes]:
    """By a pixel's neighbours (a bit for each of _AROUND) and a way, at neighbours * 8 + way: the first neighbour clockwise
    from the way, the first one counterclockwise, and whether nothing to the right is passed until then."""
    before, after, clear = [], [], []
    for on in range(256):
        for way in range(8):
            before.append(next(((way + k) % 8 for k in range(1, 9) if on >> (way + k) % 8 & 1), way))
            k = next((k for k in range(1, 9) if on >> (way - k) % 8 & 1), 8)
            after.append((way - k) % 8)
            clear.append(any((way - j) % 8 == 0 for j in range(1, k)))
    return bytes(before), bytes(after), bytes(clear)


_CLOCKWISE, _COUNTERCLOCKWISE, _CLEAR = _turns()


def outlines(mask: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """(points, is a hole) of every border of the 8-connected regions: outer ones, and those around holes.

    Points are border pixels (x, y) in order, straight runs by their ends. Borders are in the order in
    which a scan by rows meets them. Each is followed once, so time grows with the borders' length.
    """
    _, holes, sizes, points = outlines_of(mask[None])
    return list(zip(np.split(points, np.cumsum(sizes)[:-1]), holes.tolist(), strict=True)) if len(sizes) else []


def outlines_of(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mask, is a hole, number of points) of the outlines() of a stack of masks, in order, and the points of all of them."""
    n, h, w = masks.shape
    grid = np.zeros((n, h + 2, w + 2), bool)
    grid[:, 1:-1, 1:-1] = masks
    flat, wide = grid.ravel(), w + 2
    moves = [dy * wide + dx for dy, dx in _AROUND]
    near, pixels = np.zeros(flat.size, np.uint8), np.flatnonzero(flat)
    for k, by in enumerate(moves):
        near[pixels] |= flat[pixels + by].astype(np.uint8) << k
    around, seen = near.tobytes(), bytearray(flat.size)  # 1: on a border; 2: on one with nothing to its right
    begins = np.flatnonzero(flat[1:] != flat[:-1])
    outer = flat[begins + 1]
    of, holes, sizes, found = [], [], [], []
    for at, out in zip((begins + outer).tolist(), outer.tolist(), strict=True):
        if not seen[at] if out else seen[at] != 2:
            before = len(found)
            _follow(around, seen, moves, at, _WAY[0, -1 if out else 1], found)
            of.append(at)
            holes.append(not out)
            sizes.append(len(found) - before)
    points = np.array(found, int)
    place = np.stack([points % wide, points // wide % (h + 2)], axis=1) - 1
    return np.array(of, int) // (wide * (h + 2)), np.array(holes, bool), np.array(sizes, int), place


def _follow(around: bytes, seen: bytearray, moves: list[int], start: int, origin: int, found: list[int]) -> None:
    """Adds the pixels at which a border changes its direction; the scan came to its start from the origin."""
    if not around[start]:
        seen[start] = 2
        found.append(start)
        return
    way = _CLOCKWISE[around[start] * 8 + origin]
    first, here, before, begins = start + moves[way], start, -1, len(found)
    while True:
        turn = around[here] * 8 + way  # way: to the pixel before
        go = _COUNTERCLOCKWISE[turn]
        if _CLEAR[turn]:
            seen[here] = 2
        elif not seen[here]:
            seen[here] = 1
        if go != before:
            found.append(here)
        if before < 0:
            begin = go
        after = here + moves[go]
        if after == start and here == first:
            break
        here, before, way = after, go, (go + 4) % 8
    if go == begin:
        del found[begins]


def closed_length(p: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def ring_lengths(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """closed_length() of rings that lie one after another."""
    ring, after = _after(sizes)
    return np.bincount(ring, np.hypot(*(points[after] - points).T), len(sizes))


def ring_areas(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """signed_area() of rings that lie one after another."""
    ring, after = _after(sizes)
    q = points[after]
    return np.bincount(ring, points[:, 0] * q[:, 1] - q[:, 0] * points[:, 1], len(sizes)) / 2


def _after(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring, place of the next point around) of the points of rings that lie one after another."""
    ring, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    after = np.arange(1, len(ring) + 1)
    after[(starts + sizes - 1)[sizes > 0]] = starts[sizes > 0]
    return ring, after


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs of so many places from their starts."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _greatest(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the first of the greatest values of each run is; no run is empty."""
    starts = np.cumsum(sizes) - sizes
    top = values == np.repeat(np.maximum.reduceat(values, starts), sizes)
    return np.minimum.reduceat(np.where(top, np.arange(len(values)), len(values)), starts)


def _off_line(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far points are from the lines through a and b, or from a where these are one."""
    d, gap = np.broadcast_to(b - a, p.shape), p - a
    length = np.hypot(*d.T)
    return np.where(length > 0, np.abs(d[:, 0] * gap[:, 1] - d[:, 1] * gap[:, 0]) / np.where(length > 0, length, 1.0), np.hypot(*gap.T))


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline of fewer points, from which none of the others is further than the tolerance (Douglas-Peucker)."""
    if len(p) < 3:
        return p
    return simplified_rings(p.astype(float), np.array([len(p)]), np.array([tolerance]))[0]


def simplified_rings(points: np.ndarray, sizes: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, number of points) of the simplified() of rings of a point or more that lie one after another."""
    if not len(sizes):
        return points, sizes
    starts = np.cumsum(sizes) - sizes
    from_ = lambda place: np.hypot(*(points - np.repeat(points[place], sizes, axis=0)).T)
    a = _greatest(from_(starts), sizes)
    b = _greatest(from_(a), sizes)
    local = np.arange(len(points)) - np.repeat(starts, sizes)
    p = points[np.repeat(starts, sizes) + (local + np.repeat(a - starts, sizes)) % np.repeat(sizes, sizes)]  # from a on
    middle = starts + (b - a) % sizes
    keep = np.zeros(len(p), bool)
    keep[starts] = keep[middle] = True
    split = np.flatnonzero(middle != starts)
    # Stretches (first point, points within, point after: the ring's start follows its last point).
    i = np.concatenate([starts[split], middle[split]])
    within = np.concatenate([middle[split] - starts[split], (starts + sizes)[split] - middle[split]]) - 1
    j, most = np.concatenate([middle[split], starts[split]]), np.tile(tolerance[split], 2)
    while (some := within > 0).any():
        i, within, j, most = i[some], within[some], j[some], most[some]
        at, of = _places(i + 1, within), np.repeat(np.arange(len(i)), within)
        off = _off_line(p[at], p[i][of], p[j][of])
        k = _greatest(off, within)
        far = off[k] > most
        k = at[k[far]]
        keep[k] = True
        i, within, j, most = np.concatenate([i[far], k]), np.concatenate([k - i[far], (i + within)[far] + 1 - k]) - 1, np.concatenate([k, j[far]]), np.tile(most[far], 2)
    return p[keep], np.add.reduceat(keep.astype(int), starts)


def covered_pixels(polygon: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pixels in or on a polygon of a map, found within its bounds only."""
    low = np.clip(np.floor(polygon.min(axis=0)).astype(int), 0, (w, h))
    high = np.clip(np.ceil(polygon.max(axis=0)).astype(int) + 1, 0, (w, h))
    if (high <= low).any():
        return np.zeros(0, int), np.zeros(0, int)
    y, x = np.mgrid[low[1] : high[1], low[0] : high[0]]
    inside = np.zeros(x.shape, bool)
    edges = list(zip(polygon.tolist(), np.roll(polygon, -1, axis=0).tolist(), strict=True))
    for (x0, y0), (x1, y1) in edges:
        if y0 != y1:
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    for (x0, y0), (x1, y1) in edges:  # after all crossings, or these would take pixels on the border out again
        steps = max(1, int(np.ceil(max(abs(x1 - x0), abs(y1 - y0)))))
        t = np.arange(steps + 1) / steps
        ex, ey = np.rint(x0 + t * (x1 - x0)).astype(int) - low[0], np.rint(y0 + t * (y1 - y0)).astype(int) - low[1]
        ok = (ex >= 0) & (ey >= 0) & (ex < x.shape[1]) & (ey < x.shape[0])
        inside[ey[ok], ex[ok]] = True
    rows, columns = np.nonzero(inside)
    return rows + low[1], columns + low[0]


def covered_means(points: np.ndarray, sizes: np.ndarray, of: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """The mean of the covered_pixels() of each ring (three points or more) in its map of a stack; 0 if it covers none."""
    _, h, w = maps.shape
    out, starts = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
    low, high = (f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum))
    low, high = np.clip(np.floor(low).astype(int), 0, (w, h)), np.clip(np.ceil(high).astype(int) + 1, 0, (w, h))
    span = np.maximum(high - low, 0)
    for (n,), same in _alike(sizes):
        cells = span[same].prod(axis=1)
        same, cells = same[cells > 0], cells[cells > 0]
        part = np.cumsum(cells) // PIXELS
        for rows in np.split(same, np.flatnonzero(np.diff(part)) + 1) if len(same) else ():
            wide, many = span[rows, 0], span[rows].prod(axis=1)
            ring, begin = np.repeat(np.arange(len(rows)), many), np.cumsum(many) - many
            place = np.arange(many.sum()) - begin[ring]
            x, y = place % wide[ring] + low[rows, 0][ring], place // wide[ring] + low[rows, 1][ring]
            p = points[starts[rows, None] + np.arange(n)]
            inside = np.zeros(len(ring), bool)
            for e in range(n):
                a, b = p[:, e], p[:, (e + 1) % n]
                d = b - a
                flat = d[:, 1] == 0
                x0, y0, y1, dx, dy = (v[ring] for v in (a[:, 0], a[:, 1], b[:, 1], d[:, 0], np.where(flat, 1.0, d[:, 1])))
                inside ^= ((y0 > y) != (y1 > y)) & (x < dx * (y - y0) / dy + x0)
            for e in range(n):
                a, b = p[:, e], p[:, (e + 1) % n]
                steps = np.maximum(1, np.ceil(np.abs(b - a).max(axis=1)).astype(int))
                of_, t = np.repeat(np.arange(len(rows)), steps + 1), _places(np.zeros(len(rows), int), steps + 1)
                at = np.rint(a[of_] + (t / steps[of_])[:, None] * (b - a)[of_]).astype(int) - low[rows][of_]
                ok = ((at >= 0) & (at < span[rows][of_])).all(axis=1)
                inside[(begin[of_] + at[:, 1] * wide[of_] + at[:, 0])[ok]] = True
            count = np.bincount(ring[inside], minlength=len(rows))
            total = np.bincount(ring[inside], maps[of[rows][ring[inside]], y[inside], x[inside]], len(rows))
            out[rows] = np.where(count > 0, total / np.maximum(count, 1), 0.0)
    return out


def _winding(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often closed paths of edges a to b (a row of edges for each point) go around the points."""
    y = points[:, 1, None]
    turn = (b[..., 0] - a[..., 0]) * (y - a[..., 1]) - (b[..., 1] - a[..., 1]) * (points[:, 0, None] - a[..., 0])
    up, down = (a[..., 1] <= y) & (b[..., 1] > y) & (turn > 0), (a[..., 1] > y) & (b[..., 1] <= y) & (turn < 0)
    return up.sum(axis=1) - down.sum(axis=1)


def _without_folds(a: np.ndarray) -> list[np.ndarray | None]:
    """The largest outer border of what each of k closed paths of n points (k, n, 2) goes around a positive number of times; None if nothing."""
    k, n = a.shape[:2]
    b = np.roll(a, -1, axis=1)
    d = b - a
    cross = d[:, :, None, 0] * d[:, None, :, 1] - d[:, :, None, 1] * d[:, None, :, 0]
    gap = a[:, None, :, :] - a[:, :, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[:, None, :, 1] - gap[..., 1] * d[:, None, :, 0]) / cross
        u = (gap[..., 0] * d[:, :, None, 1] - gap[..., 1] * d[:, :, None, 0]) / cross
    meet = np.nonzero((np.abs(cross) > 1e-12) & (t > 1e-9) & (t < 1 - 1e-9) & (u > -1e-9) & (u < 1 + 1e-9))
    every = np.arange(k * n)
    edge, at = np.concatenate([every, every, meet[0] * n + meet[1]]), np.concatenate([np.zeros(k * n), np.ones(k * n), t[meet]])
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    p = np.round(a.reshape(-1, 2)[edge] + at[:, None] * d.reshape(-1, 2)[edge], 7)
    one = np.flatnonzero(edge[1:] == edge[:-1])
    s, e, of = p[one], p[one + 1], edge[one] // n
    long = np.hypot(*(e - s).T) > 1e-7
    s, e, of = s[long], e[long], of[long]
    border = np.zeros(len(s), bool)
    for c in range(0, len(s), max(1, PAIRS // n)):
        part = slice(c, c + max(1, PAIRS // n))
        step = e[part] - s[part]
        side, middle = np.stack([-step[:, 1], step[:, 0]], axis=1) / np.hypot(*step.T)[:, None] * 1e-5, (s[part] + e[part]) / 2
        border[part] = (_winding(middle + side, a[of[part]], b[of[part]]) > 0) & (_winding(middle - side, a[of[part]], b[of[part]]) <= 0)
    s, e, of = s[border], e[border], of[border]
    sizes = np.bincount(of, minlength=k)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    # Most borders are one loop already, in order and without a point met twice.
    after = _after(sizes)[1]
    loose = np.bincount(of, (e != s[after]).any(axis=1), k) > 0
    order = np.lexsort((s[:, 1], s[:, 0], of))
    twice = (of[order][1:] == of[order][:-1]) & (s[order][1:] == s[order][:-1]).all(axis=1)
    loose[of[order][1:][twice]] = True
    areas = ring_areas(s, sizes)
    out: list[np.ndarray | None] = []
    for i in range(k):
        own = slice(cuts[i], cuts[i + 1])
        if loose[i]:
            out.append(_largest_loop(s[own], e[own]))
        else:
            out.append(s[own] if sizes[i] > 2 and areas[i] > 0 else None)
    return out


def _largest_loop(s: np.ndarray, e: np.ndarray) -> np.ndarray | None:
    """The loop of the greatest area that steps from s to e make; None if there is none with an area."""
    leave: dict[tuple, list] = {}
    for p, q in zip(map(tuple, s.tolist()), map(tuple, e.tolist()), strict=True):
        leave.setdefault(p, []).append(q)
    best, most = None, 0.0
    while leave:
        start = next(iter(leave))
        loop, here = [start], start
        while here in leave:
            after = leave[here].pop()
            if not leave[here]:
                del leave[here]
            here = after
            if here == start:
                break
            loop.append(here)
        size = signed_area(np.array(loop)) if len(loop) > 2 else 0.0
        if size > most:
            best, most = np.array(loop), size
    return best


def round_offset(p: np.ndarray, distance: float, tolerance: float = ARC_TOLERANCE) -> np.ndarray | None:
    """A polygon moved out by a distance (in, if it is negative), arcs at its corners, folds removed; None if nothing is left.

    An arc of angle v is cut in ceil(v / (2 acos(1 - tolerance / distance))) chords.
    """
    return round_offsets(p, np.array([len(p)]), np.array([distance], float), tolerance)[0]


def round_offsets(points: np.ndarray, sizes: np.ndarray, distances: np.ndarray, tolerance: float = ARC_TOLERANCE) -> list[np.ndarray | None]:
    """round_offset() of rings that lie one after another, those with paths of as many points at once."""
    areas, starts = ring_areas(points, sizes), np.cumsum(sizes) - sizes
    out: list[np.ndarray | None] = [points[i : i + n] if size else None for i, n, size in zip(starts.tolist(), sizes.tolist(), areas.tolist(), strict=True)]
    moved = np.flatnonzero((areas != 0) & (distances != 0))
    if not len(moved):
        return out
    sizes, starts, by = sizes[moved], starts[moved], distances[moved]
    ring, at = np.repeat(np.arange(len(moved)), sizes), _places(starts, sizes)
    x = points[np.where((areas[moved] > 0)[ring], at, (2 * starts + sizes - 1)[ring] - at)].astype(float)
    after = _after(sizes)[1]
    new = np.ones(len(x), bool)
    new[after] = (x[after] != x).any(axis=1)
    x, ring = x[new], ring[new]
    sizes = np.bincount(ring, minlength=len(moved))
    after = _after(sizes)[1]
    d = x[after] - x
    normal = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    before = np.empty_like(normal)
    before[after] = normal
    far = np.abs(by)
    step = 2 * np.arccos(np.maximum(0.0, 1 - np.minimum(tolerance, far) / far))[ring]
    angle = np.arctan2(before[:, 0] * normal[:, 1] - before[:, 1] * normal[:, 0], before[:, 0] * normal[:, 0] + before[:, 1] * normal[:, 1])
    arc = angle * by[ring] > 0
    chords = np.where(arc, np.maximum(1, np.ceil(np.abs(angle) / step - 1e-9)), 0).astype(int)
    many = np.where(arc, chords + 1, np.where(angle != 0, 3, 1))
    v, j = np.repeat(np.arange(len(x)), many), _places(np.zeros(len(x), int), many)
    turn = np.arctan2(before[:, 1], before[:, 0])[v] + angle[v] * j / np.maximum(chords, 1)[v]
    flat = np.where((j == 0)[:, None] & (angle != 0)[v, None], before[v], np.where(((j == 1) & (many == 3)[v])[:, None], 0.0, normal[v]))
    path = x[v] + by[ring[v]][:, None] * np.where(arc[v, None], np.stack([np.cos(turn), np.sin(turn)], axis=1), flat)
    ring = ring[v]
    after = _after(np.bincount(ring, minlength=len(moved)))[1]
    new = np.ones(len(path), bool)
    new[after] = np.hypot(*(path[after] - path).T) > 1e-9
    path, sizes = path[new], np.bincount(ring[new], minlength=len(moved))
    starts = np.cumsum(sizes) - sizes
    for (n,), rows in _alike(sizes):
        for c in range(0, len(rows), max(1, PAIRS // max(1, n * n))):
            part = rows[c : c + max(1, PAIRS // max(1, n * n))]
            got = _without_folds(path[starts[part, None] + np.arange(n)]) if n > 2 else [None] * len(part)
            for i, q in zip(moved[part].tolist(), got, strict=True):
                out[i] = q
    return out


def grown(points: np.ndarray, sizes: np.ndarray, ratio: float) -> list[np.ndarray | None]:
    """Rings that lie one after another, moved out by area * ratio / perimeter with round corners."""
    length = ring_lengths(points, sizes)
    return [q if n else None for q, n in zip(round_offsets(points, sizes, np.abs(ring_areas(points, sizes)) * ratio / np.where(length > 0, length, 1.0)), length.tolist(), strict=True)]


def polygon_round_offset(polygon: Column, distance: Column) -> Column:
    """round_offset() of a polygon column; null where nothing is left or the polygon has under three points."""

    @F.arrow_udf(POLYGON)
    def moved(polygons: pa.Array, distances: pa.Array) -> pa.Array:
        at, sizes, points = _points(polygons)
        whole = np.flatnonzero((sizes > 2) & ~distances.is_null().to_numpy(zero_copy_only=False))
        by = distances.to_numpy(zero_copy_only=False).astype(float)[whole]
        got = round_offsets(points[_places(at[whole], sizes[whole])], sizes[whole], by)
        out: list[np.ndarray | None] = [None] * len(polygons)
        for i, q in zip(whole.tolist(), got, strict=True):
            out[i] = q
        return polygon_list(out)

    return moved(polygon, distance)


def polygon_list(polygons: list[np.ndarray | None]) -> pa.Array:
    """A column of polygons from rows of x, y; null for None."""
    sizes = np.array([0 if p is None else len(p) for p in polygons], int)
    points = np.concatenate([np.zeros((0, 2)), *(p for p in polygons if p is not None)])
    place = pa.StructArray.from_arrays([pa.array(points[:, c]) for c in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), place, mask=pa.array([p is None for p in polygons], pa.bool_()))
