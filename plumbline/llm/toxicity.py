"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its lower-cased words and their beginnings, present or not. One weight vector
w is shared by all thresholds t1 < t2 < t3: P(grade >= k) = sigmoid(w x - t_k). The expected severity
is the sum of these probabilities over k, from 0 to 3; a text is toxic if P(grade >= 1) is at least
THRESHOLD.

The model is trained here on a bounded sample of labelled rows. The labels say toxic or not, so the
grades of toxic rows come from a first fit, of the toxic threshold alone: the sample is cut in FOLDS
parts, each is scored by a fit of the others, and the toxic rows are graded by how sure that is, in
three parts of equal size. Weights have either sign; a feature is in the model if it is in enough
sampled rows and leans to either side by more than chance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_text, map_text
from .simhash import fingerprint

GRADES = 3
#: Below a half: held out, clean rows hardly reach it, and a miss is worse than a false alarm of one in a thousand.
THRESHOLD = 0.2
#: Labelled rows used for training at most, of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: A feature is in so many sampled rows at least, of SAMPLE rows; in fewer rows of a smaller sample, but in MIN_ROWS.
SAMPLE_ROWS_OF_FEATURE, MIN_ROWS = 6, 2
#: Standard errors that a feature's log odds are off zero, at least, and features at most: those furthest off.
MIN_Z, VOCABULARY = 2.5, 8192
FOLDS, L2 = 3, 1e-4
#: Sampled texts whose SimHashes differ in no more bits count once.
COPY_BITS = 8
PREFIXES = (5, 6, 7, 8)
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&-_=+/\\~`"
_CACHE_WORDS = 50_000


def word_features(word: str) -> list[str]:
    w = word.strip(_EDGE)
    return [w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)] if w else []


def text_words(text: str) -> set[str]:
    return set(text.lower().split())


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def scorer(self):
        """A function from a text to w x; it remembers the words it has met, up to a bound."""
        known: dict[str, tuple[tuple[str, float], ...]] = {}
        weights = self.weights

        begins = {f.removesuffix("*")[:4] for f in weights}

        def hits(word: str):
            got = tuple((f, weights[f]) for f in word_features(word) if f in weights) if word.strip(_EDGE)[:4] in begins else ()
            if len(known) >= _CACHE_WORDS:
                known.clear()
            known[word] = got
            return got

        def score(text: str) -> float:
            found: dict[str, float] = {}
            for word in text_words(text):
                got = known.get(word)
                if got is None:
                    got = hits(word)
                if got:
                    found.update(got)
            return math.fsum(found.values())

        return score

    def at_least(self, score: float) -> list[float]:
        """P(grade >= k) for k from 1."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def distinct_rows(texts: list[str], most_bits: int = COPY_BITS) -> list[int]:
    """Numbers of the texts that are no near copy of an earlier one: copies would vouch for all of their words."""
    fps = np.array([fingerprint(t) for t in texts], np.uint64)
    kept: list[int] = []
    for i, f in enumerate(fps):
        if not kept or int(np.bitwise_count(fps[kept] ^ f).min()) > most_bits:
            kept.append(i)
    return kept


def likelihood(params: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, grades: int, l2: float) -> tuple[float, np.ndarray]:
    """The penalised mean log-likelihood of the cumulative-link model, and its gradient.

    params are the weights of the features, the first threshold and the logs of the steps between
    thresholds; row and col say which rows have which features.
    """
    n, size = len(grade), len(params) - grades
    w, first, gaps = params[:size], params[size], params[size + 1 :]
    t = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
    z = np.bincount(row, w[col], n)
    over = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -500, 500)))
    upper = np.concatenate((np.ones((n, 1)), over, np.zeros((n, 1))), axis=1)
    i = np.arange(n)
    p = np.maximum(upper[i, grade] - upper[i, grade + 1], 1e-12)
    slope = upper * (1 - upper)
    dz = (slope[i, grade] - slope[i, grade + 1]) / p
    dt = np.zeros((n, grades))
    low, high = grade > 0, grade < grades
    dt[i[low], grade[low] - 1] -= slope[i, grade][low] / p[low]
    dt[i[high], grade[high]] += slope[i, grade + 1][high] / p[high]
    dt = dt.mean(axis=0)
    k = np.arange(grades)
    gradient = np.concatenate((np.bincount(col, dz[row], size) / n - l2 * w, [dt.sum()], [dt[k > j].sum() * np.exp(gaps[j]) for j in range(grades - 1)]))
    return float(np.log(p).mean() - l2 / 2 * (w @ w)), gradient


def _maximise(row, col, grade, size: int, grades: int, l2: float, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """The parameters of the highest likelihood, by Adam."""
    params = np.concatenate((np.zeros(size), [2.0], np.zeros(grades - 1)))
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, g = likelihood(params, row, col, grade, grades, l2)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return params


class Features:
    """The features of texts as numbers: each name is held once, a text is an array."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.rows = [np.fromiter({number.setdefault(f, len(number)) for w in text_words(t) for f in word_features(w)}, np.int32) for t in texts]
        self.names = list(number)

    def telling(self, which: np.ndarray, toxic: np.ndarray, vocabulary: int) -> np.ndarray:
        """The features that lean to either side by more than chance in some of the texts, the furthest first."""
        sides = [np.zeros(len(self.names), np.int64) for _ in range(2)]
        for i, v in zip(which.tolist(), toxic.tolist(), strict=True):
            sides[v][self.rows[i]] += 1
        n = np.bincount(toxic, minlength=2)
        least = max(MIN_ROWS, min(SAMPLE_ROWS_OF_FEATURE, len(which) * SAMPLE_ROWS_OF_FEATURE // (SAMPLE_TOXIC + SAMPLE_CLEAN)))
        some = np.flatnonzero(sides[0] + sides[1] >= least)
        a, b = sides[1][some].astype(float), sides[0][some].astype(float)
        odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
        z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        order = np.array(sorted(range(len(some)), key=lambda i: (-z[i], self.names[some[i]])), int)
        # A small sample may have nothing beyond chance: its furthest features are all there is to go by.
        found = order[:vocabulary][z[order[:vocabulary]] >= MIN_Z]
        return some[found if len(found) else order[:32]]

    def indexed(self, which: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the features that the texts have."""
        place = np.full(len(self.names), -1)
        place[features] = np.arange(len(features))
        columns = [np.sort(c[c >= 0]) for c in (place[self.rows[i]] for i in which.tolist())]
        return np.repeat(np.arange(len(which)), [len(c) for c in columns]), np.concatenate(columns) if columns else np.zeros(0, int)


def train(texts: list[str], toxic: list[int], vocabulary: int = VOCABULARY, l2: float = L2) -> Model:
    """Fits weights and thresholds; without rows of both labels the model says toxic to nothing."""
    kept = distinct_rows(texts)
    texts, y = [texts[i] for i in kept], np.array([toxic[i] for i in kept], int)
    if not len(y) or y.min() == y.max():
        return Model({}, tuple(10.0 + k for k in range(GRADES)))
    features = Features(texts)
    every = np.arange(len(y))
    fold = every % FOLDS
    sure = np.zeros(len(y))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if y[rest].min() == y[rest].max():
            continue
        chosen = features.telling(rest, y[rest], vocabulary)
        params = _maximise(*features.indexed(rest, chosen), y[rest], len(chosen), 1, l2, steps=150)
        row, col = features.indexed(own, chosen)
        sure[own] = np.bincount(row, params[:-1][col], len(own)) - params[-1]
    at = np.flatnonzero(y)
    grade = np.zeros(len(y), int)
    grade[at[np.lexsort((at, sure[at]))]] = 1 + np.arange(len(at)) * GRADES // len(at)
    chosen = features.telling(every, y, vocabulary)
    names = [features.names[i] for i in chosen.tolist()]
    params = _maximise(*features.indexed(every, chosen), grade, len(names), GRADES, l2)
    t = params[len(names)] + np.concatenate(([0], np.cumsum(np.exp(params[len(names) + 1 :]))))
    return Model({f: float(x) for f, x in zip(names, params, strict=False) if abs(x) > 1e-3}, tuple(t.tolist()))


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """Trains on the labelled rows of the smallest id hashes, within the bounds."""
    marked = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = [marked.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, sample_toxic), (0, sample_clean))]
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    got = rows.toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    return train(got["text"].tolist(), got["toxic"].tolist())


def toxicity(df: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_toxic, expected_severity (0 to 3), grade (the likeliest) and toxic of each row.

    A null or empty text has no features and the severity of the thresholds alone. Null ids and
    repeated rows pass through row by row; an empty table gives no rows; other columns are ignored.
    """

    def make():
        score = model.scorer()

        def run(texts):
            over = [model.at_least(score(t)) for t in texts]
            p = [o[0] for o in over]
            grades = []
            for o in over:
                each = [a - b for a, b in zip([1.0, *o], [*o, 0.0], strict=True)]
                grades.append(each.index(max(each)))
            return [p, [sum(o) for o in over], grades, [x >= threshold for x in p]]

        return run

    return map_text(df, make, "p_toxic double, expected_severity double, grade int, toxic boolean", text, [doc_id])


def keep_civil(df: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose text is not toxic.

    Null and empty texts have no features and stay, unless the thresholds alone speak against them; long
    texts are read whole; repeated rows stay or go together; an empty table stays empty; other columns
    stay as they are, whatever their names.
    """

    def make():
        score = model.scorer()
        return lambda texts: [model.at_least(score(t))[0] < threshold for t in texts]

    return filter_text(df, make, text)
