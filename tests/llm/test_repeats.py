"""Removal of repeated bytes against a table of all windows."""

import random

import numpy as np
import pytest

from plumbline.llm import repeats
from plumbline.llm.common import read_table

SCHEMA = "doc_id long, text string, at long, h string, size int"


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, repeats.remove_repeats(df, **kw).collect()), key=str)
    assert got == sorted(repeats.brute_force(rows, kw.get("length", 100)), key=str)
    return got


def passages(seed, docs=300):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    pool = [text(rng.randrange(80, 400)) for _ in range(12)]
    return pool, [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else text(rng.randrange(1, 150)) for _ in range(rng.randrange(0, 6)))) for i in range(docs)]


@pytest.mark.parametrize("most", [3, repeats.MOST])
def test_passages(spark, most):
    """Copies, overlaps, nulls, empty texts, runs of one letter, repeated and null ids; small and large groups."""
    pool, rows = passages(most)
    rows += [(1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 3000), (None, "".join(pool[:3])), (None, "x" * 150)]
    rows += [(3, "é🎉" * 200 + pool[0]), (3, rows[3][1]), (3, rows[3][1]), (1004, "é🎉" * 200 + pool[0]), (2**63 - 1, pool[2])]
    assert sum(r[2] for r in check(spark, rows, most=most)) > 50_000


def test_lengths(spark):
    _, rows = passages(9, 80)
    check(spark, rows, length=40, gram=16)
    check(spark, rows, length=101, gram=99)


def test_boundary(spark):
    """A run of 99 equal bytes stays, one of 100 goes; a common line in unlike texts stays."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x = text(100)
    got = check(spark, [(1, text(80) + "1" + x + "1" + text(90)), (2, text(70) + "2" + x[:99] + "#" + text(20)), (3, "#" + x[1:] + "3" + text(120)), (4, text(11) + "4" + x)])
    assert [r[2] for r in sorted(got)] == [0, 0, 0, 100]
    line = "one common line of under a hundred characters that many texts have"
    assert sum(r[2] for r in check(spark, [(i, text(150) + line + text(150)) for i in range(200)], most=20)) == 0
    assert sum(r[2] for r in check(spark, [(i, text(150) + x + text(150)) for i in range(200)], most=20)) >= 199 * 100


def test_long_text_in_pieces(spark):
    """A text of several pieces, with a passage that lies across a cut and another's copy."""
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 123, 3 * repeats.PIECE // 2, np.uint8)).decode()
    passage = raw[repeats.PIECE - 150 : repeats.PIECE + 150]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame([(1, raw), (2, "x" * 90 + passage), (0, raw[-500:])], "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (0, 1, 2)] == [0, 500, 300] and got[2]["n_spans"] == 1


def test_suffix_sort():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 4000, np.uint8)
    starts = np.sort(rng.integers(0, 3900, 700))
    segment = np.arange(700) // 90
    order, same = repeats.suffix_sort(buf, starts, segment)
    raw = buf.tobytes()
    want = sorted(range(700), key=lambda i: (segment[i], raw[starts[i] : starts[i] + 100], i))
    assert order.tolist() == want
    for k in range(1, 700):
        i, j = want[k - 1], want[k]
        assert same[k] == (segment[i] == segment[j] and raw[starts[i] :][:100] == raw[starts[j] :][:100])


def test_colliding_hashes_are_found(monkeypatch):
    """With hashes of a few bits the neighbours' bytes tell, and another base is tried."""
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 100, 3000, np.uint8)
    tried, equal = [], repeats.Hashes.equal

    def weak(self, x, y, size):
        if self.seed < 3:
            return np.ones(len(x), bool)
        return equal(self, x, y, size)

    init = repeats.Hashes.__init__

    def start(self, b, seed):
        tried.append(seed)
        self.seed = seed
        init(self, b, seed)

    monkeypatch.setattr(repeats.Hashes, "__init__", start)
    monkeypatch.setattr(repeats.Hashes, "equal", weak)
    starts = np.sort(rng.integers(0, 2900, 300))
    order, _ = repeats.suffix_sort(buf, starts, np.zeros(300, int), seed=1)
    raw = buf.tobytes()
    assert tried == [1, 2, 3] and order.tolist() == sorted(range(300), key=lambda i: (raw[starts[i] : starts[i] + 100], i))


def test_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    assert sum(r[2] for r in check(spark, rows)) > 0
    assert check(spark, []) == []
