"""The trained models' objectives: against brute force, their gradients against differences, and what they learn."""

import itertools
import math

import numpy as np
import pytest

from plumbline.llm import quality, toxicity
from plumbline.llm.common import read_table


def differences(f, at, step=1e-6):
    at = at.astype(float)
    out = np.zeros(at.size)
    for i in range(at.size):
        up, down = at.copy(), at.copy()
        up.flat[i] += step
        down.flat[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out.reshape(at.shape)


def test_cumulative_link_likelihood():
    rng = np.random.default_rng(0)
    row, col = np.array([0, 0, 1, 2, 2, 2, 4]), np.array([0, 3, 1, 0, 2, 3, 1])
    grade = np.array([0, 2, 3, 1, 0])
    params = rng.normal(size=4 + 3)
    value, gradient = toxicity.likelihood(params, row, col, grade, 3, 0.1)
    t = [params[4], params[4] + math.exp(params[5]), params[4] + math.exp(params[5]) + math.exp(params[6])]
    want = -0.05 * sum(params[:4] ** 2)
    for i, g in enumerate(grade):
        z = sum(params[c] for r, c in zip(row, col, strict=True) if r == i)
        over = [1.0, *(1 / (1 + math.exp(x - z)) for x in t), 0.0]
        want += math.log(over[g] - over[g + 1]) / len(grade)
    assert value == pytest.approx(want)
    assert gradient == pytest.approx(differences(lambda p: toxicity.likelihood(p, row, col, grade, 3, 0.1)[0], params), abs=1e-6)


def test_field_likelihood():
    rng = np.random.default_rng(1)
    n_features = 5
    sequences = [rng.integers(0, 2, (n, n_features)).astype(float) for n in (4, 1, 3)]
    labels = [rng.integers(0, 2, len(s)) for s in sequences]
    emit, move = rng.normal(size=(n_features, 2)), rng.normal(size=(2, 2))
    batch = quality.Batch(sequences, labels, np.float64)
    value, by_emit, by_move = quality.objective(emit, move, batch, 0.1)

    def score(x, y):
        return sum(x[i] @ emit[:, v] for i, v in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y))

    want = -0.05 * ((emit**2).sum() + (move**2).sum())
    for x, y in zip(sequences, labels, strict=True):
        every = [score(x, z) for z in itertools.product((0, 1), repeat=len(x))]
        want += (score(x, y) - math.log(sum(map(math.exp, every)))) / len(x) / len(sequences)
    assert value == pytest.approx(want)
    assert by_emit == pytest.approx(differences(lambda w: quality.objective(w, move, batch, 0.1)[0], emit), abs=1e-6)
    assert by_move == pytest.approx(differences(lambda w: quality.objective(emit, w, batch, 0.1)[0], move), abs=1e-6)


def labelled(spark, limit=1500):
    path = "/root/testdata/sf0.1"
    rows = read_table(spark, path, "documents").join(read_table(spark, path, "labels"), "doc_id").orderBy("doc_id").limit(limit)
    return rows.select("text", "quality", "toxic").collect()


def test_lines_of_mixed_documents(spark):
    """Held-out documents of good lines around bad ones: the lines are told apart."""
    rows = [r for r in labelled(spark) if r.text.count("\n") < 200]
    good, bad = ([r.text for r in rows if r.quality == v and len(r.text.split()) >= 50] for v in (1, 0))
    n = len(bad) // 2
    field = quality.train_on([*good[: 2 * n], *bad[:n]], [1] * 2 * n + [0] * n)
    right = total = switches = 0
    for a, b in zip(good[2 * n :], bad[n:], strict=False):
        a, b = ([x for x in t.split("\n") if x.split()] for t in (a, b))
        cut = (len(a) + 1) // 2
        c = quality.count(["\n".join([*a[:cut], *b, *a[cut:]])])
        said = field.decode(field.scores(c).tolist())
        truth = [1] * cut + [0] * len(b) + [1] * (len(a) - cut)
        right += sum(x == y for x, y in zip(said, truth, strict=True))
        total += len(truth)
        switches += 0 < sum(said) < len(said)
    assert total > 200 and right >= 0.85 * total and switches >= 0.8 * min(len(good) - 2 * n, len(bad) - n)


def test_fits_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    for some in (none, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (9, 0, 1)], none.schema)):
        field = quality.fit(docs, some)
        assert field.emit.shape == (quality.N_FEATURES, 2)
        assert toxicity.fit(docs, some).at_least(0.0)[0] < toxicity.THRESHOLD


def test_small_samples_find_toxic_rows(spark, sf_dir):
    """With eleven toxic labels the model still tells most toxic rows, and none of the clean ones."""
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id").collect()
    model = toxicity.train([r.text for r in rows], [r.toxic for r in rows])
    score = model.scorer()
    said = [model.at_least(score(r.text))[0] >= toxicity.THRESHOLD for r in rows]
    assert sum(s for s, r in zip(said, rows, strict=True) if r.toxic) >= 6
    assert sum(s for s, r in zip(said, rows, strict=True) if not r.toxic) <= 2
    assert any(w < 0 for w in model.weights.values()) and any(w > 0 for w in model.weights.values())
