"""Recall of the multi-index against brute force, on tables that are not scanned whole."""

from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import multi_index


def table(kind, n=12_000, width=32):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width))
    if kind == "clustered":
        x = rng.normal(size=(60, width))[rng.integers(0, 60, n)] + 0.25 * x
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize(("kind", "most_scanned"), [("clustered", 0.3), ("isotropic", 1.0)])
def test_recall(spark, kind, most_scanned, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_VECTORS", 1000)  # several blocks, parts of hot cells and copies of blocks
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 200)
    x = table(kind)
    index = multi_index.build(x, 20, multi_index.centroids_for(len(x)))
    assert index.share < most_scanned
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in multi_index.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in dict(found)
        assert all(np.isclose(s, scores[i], rtol=0, atol=1e-9) for i, s in found)
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20].tolist()) & set(dict(found)))
    assert hits >= 0.9 * 20 * len(got)


def test_heap_gives_cells_by_score():
    x = table("clustered", 2000)
    index = multi_index.build(x, 20, 16)
    sizes = np.bincount(index.assign(x), minlength=index.cells)
    for q in x[:20]:
        cells = index.probe(q, sizes, 700)
        scores = index.scores(q[None], np.arange(index.cells))[0]
        want = [c for c in np.argsort(-scores, kind="stable").tolist() if sizes[c]]
        assert cells == want[: len(cells)] and sizes[cells].sum() >= 700 > sizes[cells[:-1]].sum()
