"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of `length` bytes (a window) that covers it also starts earlier: in a smaller
document or earlier in the same one. Two suffixes are compared by their common extension, which binary
search finds over prefix polynomial hashes; suffixes are put in order by mergesort with that comparison,
so a comparison takes log2(length) hash look-ups; and every pair of neighbours in the result is compared
byte by byte, a collision found there sorts anew with another base. So equal windows stand together, the
earliest first.

What is sorted together. Equal windows choose the same anchor: the least of the hashes of their GRAM-byte
strings, the leftmost of equal ones. Windows of a document that share an anchor are consecutive, and with
the bytes they cover they are a fragment; only fragments whose anchors' strings are equal can share a
window. A document of n bytes has about n / 39 fragments, and a row of 32 bytes for each is all that the
search for equal anchors shuffles:

1. Fragments that are equal as a whole (128 bits of two polynomial hashes, one of the anchor, one of the
   fragment) need no sorting: all but the earliest go. Those that a task meets again within a slice of
   text it settles alone, so a text with a third of all rows costs a few rows a task.
2. Different fragments of equal anchors are contested. They are cut from the texts and suffix-sorted, each
   anchor by itself, windows by their place relative to the anchor. An anchor with more than MOST
   fragments is not sorted in one task: its windows are told apart by 128-bit digests, counted and
   joined in Spark, where partial aggregation and splits of skewed joins apply. An anchor that is common
   within a slice already is dealt to SPREAD tasks in step 1.
3. Spans meet the texts by document and are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _slices, checkpointed, discard, release_memory, spread, text_or_empty

LENGTH, GRAM = 100, 24
#: Window starts that are hashed at a time.
PIECE = 1 << 19
#: Fragments of an anchor that are sorted in one task, and bytes of fragments sorted at a time.
MOST, SORT_BYTES = 4096, 1 << 20
#: An anchor with more different fragments within a slice is dealt to so many tasks.
COMMON, SPREAD = 16, 64
#: Equal fragments that a task remembers from earlier slices.
REMEMBERED = 1 << 16
_LAST = 2**63 - 1  # a null id's place in the order
_POSITION = np.uint64((1 << 20) - 1)
_CONTESTED, _DEALT = 1 << 16, 1 << 17
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def _bytes_as(seed: int) -> tuple[np.ndarray, int]:
    """A random number for each byte, and a base."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False), int(rng.integers(0, 1 << 61)) * 8 + 5


@cache
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base = _bytes_as(seed)[1]
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


class Hashes:
    """Prefix polynomial hashes of a buffer modulo 2^64."""

    def __init__(self, buf: np.ndarray, seed: int):
        size = 1 << max(10, (len(buf) + 1).bit_length())  # few sizes of tables
        self.power, self.inverse = _powers(seed, size)
        self.prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_bytes_as(seed)[0][buf] * self.power[: len(buf)], out=self.prefix[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def equal(self, x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
        return (self.prefix[x + size] - self.prefix[x]) * self.power[y] == (self.prefix[y + size] - self.prefix[y]) * self.power[x]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def fragments(buf: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Fragments of the strings that bounds cut buf into (under 2^20 bytes in all).

    string: which one; start: of its first window in buf; n: windows; off: of the anchor from there;
    h: hash of the anchor's string; f: hash of all that the fragment covers.
    """
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    total = int(sizes.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("string", "start", "n", "off"), none) | dict.fromkeys(("h", "f"), none.view(np.uint64))
    string = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(total) + (bounds[:-1] - (np.cumsum(sizes) - sizes))[string]
    hashes = Hashes(buf, _SEEDS[0])
    grams = _mixed(hashes.of(np.arange(len(buf) - gram + 1), gram))
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    wide, step = length - gram + 1, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    anchor = (least[starts] & _POSITION).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1])))
    first = np.nonzero(new)[0]
    start, anchor, n = starts[first], anchor[first], np.diff([*first, total])
    whole = Hashes(buf, _SEEDS[1]).of(start, n + length - 1)
    f = _mixed(whole + ((n << 8) + anchor - start).astype(np.uint64) * np.uint64(_SEEDS[2]))
    return {"string": string[first], "start": start, "n": n, "off": anchor - start, "h": grams[anchor], "f": f}


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(rows, begins, buffer, bounds): texts together up to PIECE bytes; a longer one in parts that overlap by length - 1."""
    a = 0
    while a < len(offsets) - 1:
        b = a + 1
        if offsets[b] - offsets[a] > PIECE:
            for begin in range(0, int(offsets[b] - offsets[a]), PIECE):
                part = data[offsets[a] + begin : min(offsets[b], offsets[a] + begin + PIECE + length - 1)]
                yield np.array([a]), np.array([begin]), part, np.array([0, len(part)])
        else:
            while b < len(offsets) - 1 and offsets[b + 1] - offsets[a] <= PIECE:
                b += 1
            rows = np.arange(a, b)
            yield rows, np.zeros(b - a, np.int64), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, and where each begins."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Settler:
    """Tells which fragments of a slice repeat one that the task knows to be earlier."""

    def __init__(self):
        self.known: dict[int, tuple[int, int, int]] = {}
        self.keys = np.zeros(0, np.uint64)

    def repeats(self, h: np.ndarray, f: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = np.lexsort((at, doc, h, f))
        h_, f_, doc_, at_ = h[order], f[order], doc[order], at[order]
        new = np.concatenate(([True], (f_[1:] != f_[:-1]) | (h_[1:] != h_[:-1])))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(f_)), 0))
        later = (doc_ > doc_[lead]) | (at_ > at_[lead])
        heads = np.nonzero(new)[0]
        met = heads[np.isin(f_[heads], self.keys)]
        for i in met.tolist():
            seen = self.known[int(f_[i])]
            here = int(h_[i]), int(doc_[i]), int(at_[i])
            if here[0] == seen[0]:
                later[i] = here > seen
                self.known[int(f_[i])] = min(here, seen)
        size = np.diff([*heads, len(f_)])
        often = heads[(size > 1) & ~np.isin(f_[heads], self.keys)]
        if len(often):
            if len(self.known) + len(often) > REMEMBERED:
                self.known = {}
            self.known |= {int(k): (int(g), int(d), int(a)) for k, g, d, a in zip(f_[often], h_[often], doc_[often], at_[often], strict=True)}
            self.keys = np.fromiter(self.known, np.uint64, len(self.known))
        out = np.zeros(len(f), bool)
        out[order] = later
        return out


def _anchors(length: int, gram: int):
    """Rows (h, f, doc, tid, at, pack) of fragments, and of spans that repeat for certain: h null, f their bytes."""

    def run(batches):
        settler = _Settler()
        for batch in batches:
            for a, b in _slices(batch.column(2)):
                part = batch.slice(a, b - a)
                doc, tid = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for rows, begins, buf, bounds in _pieces(*_bytes_of(part.column(2)), length):
                    x = fragments(buf, bounds, length, gram)
                    if not len(x["h"]):
                        continue
                    row, at = rows[x["string"]], x["start"] - bounds[x["string"]] + begins[x["string"]]
                    again = settler.repeats(x["h"], x["f"], doc[row], at)
                    left = np.nonzero(~again)[0]
                    h, f = x["h"][left], x["f"][left]
                    pack = x["n"][left] | x["off"][left] << 8
                    values, which, count = np.unique(h, return_inverse=True, return_counts=True)
                    if (count > COMMON).any():
                        order = np.argsort(which, kind="stable")
                        place = np.empty(len(h), np.int64)
                        place[order] = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                        common = count[which] > COMMON
                        # Two stay with the anchor's other rows and tell them that it is contested.
                        pack = pack | np.where(common, _CONTESTED, 0) | np.where(common & (place > 1), _DEALT, 0)
                    span = np.nonzero(again)[0]
                    if len(span):
                        end = at[span] + x["n"][span]
                        new = np.concatenate(([True], (row[span][1:] != row[span][:-1]) | (at[span][1:] > end[:-1])))
                        first = np.nonzero(new)[0]
                        last = np.concatenate((first[1:], [len(span)])) - 1
                        span, size = span[first], end[last] - at[span[first]] + length - 1
                    else:
                        size = span
                    chosen = np.concatenate((left, span))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate((h.view(np.int64), np.zeros(len(span), np.int64))), mask=np.arange(len(chosen)) >= len(left)),
                            pa.array(np.concatenate((f.view(np.int64), size))),
                            pa.array(doc[row[chosen]]),
                            pa.array(tid[row[chosen]]),
                            pa.array(at[chosen]),
                            pa.array(np.concatenate((pack, np.zeros(len(span), np.int64))).astype(np.int32)),
                        ],
                        ["h", "f", "doc", "tid", "at", "pack"],
                    )
        release_memory()

    return run


_SPANS = "doc long, tid long, at long, size long, off int, h long"


def _met(length: int):
    """Of anchors in order of (h, f, doc, at): spans (off is -1) of fragments that have an earlier equal, and contested fragments (size: windows)."""

    def made(doc, tid, at, size, off, h):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tid), pa.array(at), pa.array(size), pa.array(off.astype(np.int32)), pa.array(h)], ["doc", "tid", "at", "size", "off", "h"])

    def run(batches):
        last = None  # (h, f, doc and at of f's first, that h is contested)
        waiting = None  # the first row of an anchor that has one fragment so far
        for batch in batches:
            if not batch.num_rows:
                continue
            settled = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            h, f, doc, tid, at, pack = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns)
            if settled.any():
                s = settled
                yield made(doc[s], tid[s], at[s], f[s], np.full(s.sum(), -1), np.zeros(s.sum(), np.int64))
                h, f, doc, tid, at, pack = (v[~s] for v in (h, f, doc, tid, at, pack))
            m = len(h)
            if not m:
                continue
            new_h = np.concatenate(([last is None or h[0] != last[0]], h[1:] != h[:-1]))
            new_f = new_h | np.concatenate(([last is None or f[0] != last[1]], f[1:] != f[:-1]))
            lead = np.maximum.accumulate(np.where(new_f, np.arange(m), -1))
            first_doc = np.where(lead >= 0, doc[lead], last[2][0] if last else 0)
            first_at = np.where(lead >= 0, at[lead], last[2][1] if last else 0)
            later = (doc > first_doc) | (at > first_at)
            group = np.cumsum(new_h) - new_h[0]
            kinds = np.bincount(group, weights=new_f).astype(np.int64)
            flagged = np.bincount(group, weights=pack & _CONTESTED) > 0
            if not new_h[0]:
                kinds[0] += 1
                flagged[0] |= last[3]
            contested = (kinds > 1) | flagged
            size = (pack & 0xFF).astype(np.int64)
            if later.any():
                yield made(doc[later], tid[later], at[later], size[later] + length - 1, np.full(later.sum(), -1), h[later])
            if waiting is not None and not new_h[0] and contested[0]:
                yield waiting
            if waiting is not None and (new_h[0] or contested[0]):
                waiting = None
            open_ = contested[group] & ~later
            if open_.any():
                yield made(doc[open_], tid[open_], at[open_], size[open_], (pack >> 8 & 0xFF)[open_], h[open_])
            tail = group[-1]
            if not contested[tail] and waiting is None:
                i = np.nonzero((group == tail) & ~later)[0]
                waiting = made(doc[i], tid[i], at[i], size[i], (pack >> 8 & 0xFF)[i], h[i])
            elif not contested[tail]:
                i = np.nonzero((group == tail) & ~later)[0]
                if len(i):  # equal rows at the same place
                    waiting = pa.Table.from_batches([waiting, made(doc[i], tid[i], at[i], size[i], (pack >> 8 & 0xFF)[i], h[i])]).combine_chunks().to_batches()[0]
            last = (h[-1], f[-1], (first_doc[-1], first_at[-1]), bool(contested[tail]))

    return run


def _cut(length: int):
    """Rows (h, doc, tid, at, n, off, bytes) of contested fragments, from rows (doc, tid, text, found)."""

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(2)):
                part = batch.slice(a, b - a)
                found = part.column(3)
                own = np.repeat(np.arange(len(part)), found.value_lengths().to_numpy(zero_copy_only=False))
                at, n, off, h = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("at", "size", "off", "h"))
                texts = [t.encode() for t in part.column(2).to_pylist()]
                pieces = [texts[i][p : p + q] for i, p, q in zip(own.tolist(), at.tolist(), (n + length - 1).tolist(), strict=True)]
                doc, tid = (part.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
                for c in range(0, len(own), 4096):
                    s = slice(c, c + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(doc[s]), pa.array(tid[s]), pa.array(at[s]), pa.array(n[s].astype(np.int32)), pa.array(off[s].astype(np.int32)), pa.array(pieces[s], pa.binary())], ["h", "doc", "tid", "at", "n", "off", "bytes"])
        release_memory()

    return run


def _order(hashes: Hashes, buf: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the suffixes at x come before, equal or come after those at y, by their first length bytes."""
    out = np.zeros(len(x), np.int8)
    differ = np.nonzero(~hashes.equal(x, y, length))[0]
    x, y = x[differ], y[differ]
    common, step = np.zeros(len(x), np.int64), 1 << (length.bit_length() - 1)
    while step:
        may = np.nonzero(common + step < length)[0]
        same = may[hashes.equal(x[may] + common[may], y[may] + common[may], step)]
        common[same] += step
        step >>= 1
    out[differ] = np.where(buf[x + common] < buf[y + common], -1, 1)
    return out


def suffix_sort(buf: np.ndarray, starts: np.ndarray, segment: np.ndarray, length: int = LENGTH, seed: int = _SEEDS[2]) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within each segment by their first length bytes, and which equal the one before them.

    segment is ascending. The mergesort is stable and merges all runs of a level at once: each suffix
    finds its place in the run it is merged with by binary search.
    """
    n = len(starts)
    hashes = Hashes(buf, seed)
    new = np.concatenate(([True], segment[1:] != segment[:-1])) if n else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    sizes = np.diff([*first, n])
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    order, width = np.arange(n), 1
    while n and width < sizes.max():
        i = np.nonzero(size > width)[0]
        place = i - begin[i]
        run = place // width
        low = begin[i] + (run ^ 1) * width
        end = np.minimum(low + width, begin[i] + size[i])
        keep = low < end
        i, place, run, low, end = i[keep], place[keep], run[keep], low[keep], end[keep]
        rank, high = low.copy(), end.copy()
        while True:
            at = np.nonzero(rank < high)[0]
            if not len(at):
                break
            middle = (rank[at] + high[at]) // 2
            sign = _order(hashes, buf, starts[order[middle]], starts[order[i[at]]], length)
            before = (sign < 0) | ((sign == 0) & (run[at] % 2 == 1))
            rank[at] = np.where(before, middle + 1, rank[at])
            high[at] = np.where(before, high[at], middle)
        merged = order.copy()
        merged[begin[i] + run // 2 * 2 * width + place - run * width + rank - low] = order[i]
        order, width = merged, 2 * width
    same = np.zeros(n, bool)
    inner, span = np.nonzero(~new)[0], np.arange(length)
    for a in range(0, len(inner), 1 << 13):
        i = inner[a : a + (1 << 13)]
        x, y = buf[starts[order[i - 1]][:, None] + span], buf[starts[order[i]][:, None] + span]
        differ = x != y
        at = differ.argmax(axis=1)
        row = np.arange(len(i))
        same[i] = ~differ[row, at]
        if (x[row, at] > y[row, at]).any():  # hashes collided
            return suffix_sort(buf, starts, segment, length, seed + 1)
    return order, same


def _windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fragment, and which of its windows."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _spans(which, window, again, doc, tid, at, length) -> pa.RecordBatch:
    """Windows again (in order of fragment and window) as spans."""
    w, p = which[again], window[again]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1))) if len(w) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    size = np.diff([*first, len(w)]) + length - 1
    w, p = w[first], p[first]
    return pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(tid[w]), pa.array(at[w] + p), pa.array(size)], ["doc", "tid", "at", "size"])


def repeated_windows(h: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, pieces: Sequence[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which fragment, which window, whether an earlier window equals it), of fragments in order of (h, doc, at)."""
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    which, window = _windows(n)
    group = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
    segment = group[which] << 8 | (off[which] - window)
    by = np.argsort(segment, kind="stable")  # (doc, at) ascends within a segment
    order, same = suffix_sort(buf, (base[which] + window)[by], segment[by], length)
    sorted_ = by[order]
    lead = sorted_[np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))]
    start = at[which] + window
    again = np.zeros(len(which), bool)
    again[sorted_] = (doc[which[sorted_]] > doc[which[lead]]) | (start[sorted_] > start[lead])
    return which, window, again


def _sorted_fragments(length: int):
    """Spans (doc, tid, at, size) of windows that have an earlier equal, of fragments in order of (h, doc, at)."""

    def settle(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        h, doc, tid, at, n, off = (t.column(k).to_numpy() for k in ("h", "doc", "tid", "at", "n", "off"))
        which, window, again = repeated_windows(h, doc, at, n.astype(np.int64), off.astype(np.int64), t.column("bytes").to_pylist(), length)
        return _spans(which, window, again, doc, tid, at, length)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            while len(h):
                if held and size >= SORT_BYTES:
                    last = held[-1].column(0)[-1].as_py()
                    stop = int(np.argmax(h != last)) if (h != last).any() else len(h)
                    if stop:
                        held.append(batch.slice(0, stop))
                    if stop < len(h):
                        yield settle(held)
                        held, size = [], 0
                    batch, h = batch.slice(stop), h[stop:]
                else:
                    take = min(len(h), max(1, (SORT_BYTES - size) // (2 * length) + 1))
                    held.append(batch.slice(0, take))
                    size += int(held[-1].column(4).to_numpy().sum()) + take * (length - 1)
                    batch, h = batch.slice(take), h[take:]
        if held:
            yield settle(held)
        release_memory()

    return run


def _digests(length: int):
    """Rows (d1, d2, doc, tid, at) of all windows of fragments."""

    def run(batches):
        for batch in batches:
            n = batch.column(4).to_numpy().astype(np.int64)
            doc, tid, at = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for a in range(0, len(n), 256):
                which, window = _windows(n[a : a + 256])
                pieces = batch.column(6).slice(a, 256).to_pylist()
                raw = b"".join(hashlib.blake2b(pieces[i][p : p + length], digest_size=16).digest() for i, p in zip(which.tolist(), window.tolist(), strict=True))
                d = np.frombuffer(raw, np.int64).reshape(-1, 2)
                which = which + a
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(doc[which]), pa.array(tid[which]), pa.array(at[which] + window)], ["d1", "d2", "doc", "tid", "at"])
        release_memory()

    return run


def _contested_spans(cut: DataFrame, length: int, most: int) -> DataFrame:
    """Spans of the windows of contested fragments that have an earlier equal."""
    crowded = cut.groupBy("h").count().where(F.col("count") > most).select("h")
    few = cut.join(crowded, "h", "left_anti").repartition("h").sortWithinPartitions("h", "doc", "at")
    spans = few.mapInArrow(_sorted_fragments(length), "doc long, tid long, at long, size long")
    windows = cut.join(crowded, "h", "left_semi").select("h", "doc", "tid", "at", "n", "off", "bytes").mapInArrow(_digests(length), "d1 long, d2 long, doc long, tid long, at long")
    first = windows.groupBy("d1", "d2").agg(F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("last")).where("first <> last")
    more = windows.join(first, ["d1", "d2"]).where(F.struct("doc", "at") > F.col("first"))
    return spans.unionAll(more.select("doc", "tid", "at", F.lit(length).cast("long").alias("size")))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """What is left of a text, bytes removed, and maximal removed runs, by spans (start, size)."""
    left, at, removed, runs, open_ = [], 0, 0, 0, -1
    for start, size in sorted(spans):
        end = start + size
        if start > at or open_ < 0:
            left.append(text[at:start])
            runs += 1
            removed += size
        elif end > at:
            removed += end - at
        at, open_ = max(at, end), 0
    left.append(text[at:])
    return left, removed, runs


def _results(batches):
    for batch in batches:
        for a, b in _slices(batch.column(1)):
            part = batch.slice(a, b - a)
            rows = []
            for text, at, size in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = text.encode()
                left, removed, runs = _kept(raw, list(zip(at or (), size or (), strict=True)))
                rows.append((len(raw), removed, runs, hashlib.sha256(b"".join(left)).hexdigest()))
            made = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    release_memory()


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): rows (doc_id, doc, tid, text), and (doc, tid, at, size) of what goes; spans may overlap and repeat."""
    if not 8 <= gram < length <= 200 + gram:
        raise ValueError("gram must be 8 or more and under length, length - gram 200 at most")
    source = F.col(f"`{doc_id}`")
    # Where ids repeat, a hash of the text tells their texts apart.
    repeats = not df.groupBy(source.cast("long")).count().where("count > 1").isEmpty()
    tid: Column = F.xxhash64(text_or_empty(text)) if repeats else F.lit(0).cast("long")
    texts = df.select(source.alias("doc_id"), F.coalesce(source.cast("long"), F.lit(_LAST)).alias("doc"), tid.alias("tid"), text_or_empty(text).alias("text"))
    found = spread(texts.select("doc", "tid", "text")).mapInArrow(_anchors(length, gram), "h long, f long, doc long, tid long, at long, pack int")
    dealt = F.when(F.col("pack").bitwiseAND(_DEALT) != 0, F.xxhash64("h", F.pmod("f", F.lit(SPREAD)))).otherwise(F.coalesce("h", F.xxhash64("doc", "at")))
    met = checkpointed(found.repartition(dealt).sortWithinPartitions("h", "f", "doc", "at").mapInArrow(_met(length), _SPANS))
    contested = met.where("off >= 0").groupBy("doc", "tid").agg(F.collect_list(F.struct("at", "size", "off", "h")).alias("found"))
    named = texts.select("doc", "tid", "text")
    cut = named.join(contested, ["doc", "tid"]).select("doc", "tid", "text", "found")
    cut = checkpointed(cut.mapInArrow(_cut(length), "h long, doc long, tid long, at long, n int, off int, bytes binary"))
    more = checkpointed(_contested_spans(cut, length, most))
    discard(cut)
    return texts, met.where("off < 0").select("doc", "tid", "at", "size").unionAll(more)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    doc_id is an integer. A null text is empty; a text shorter than length loses nothing. Null ids come
    after all others, as one document. Order is (doc_id, start) alone: of rows with one id neither is
    earlier at the same start, so equal rows get equal results, and a repeated id's other text counts as
    earlier where its start is smaller. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    texts, spans = repeated_spans(df, doc_id, text, length, gram, most)
    own = spans.groupBy("doc", "tid").agg(F.collect_list(F.struct("at", "size")).alias("own"))
    rows = texts.join(own, ["doc", "tid"], "left").select("doc_id", "text", "own.at", "own.size")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_results, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(rows: Sequence[tuple], length: int = LENGTH) -> list[tuple]:
    """What remove_repeats() gives of (doc_id, text), by a table of all windows; for tests."""
    first: dict[bytes, tuple] = {}
    raw = [((i is None, i or 0), (t or "").encode()) for i, t in rows]
    for key, t in raw:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for (key, t), (i, _) in zip(raw, rows, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (key, p):
                gone[p : p + length] = b"\1" * length
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out
