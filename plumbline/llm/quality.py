"""Quality rules by line labelling: a linear-chain conditional random field marks each line.

A text's lines with a word are a sequence; each gets indicator features of its words, symbols, case,
punctuation and repetition. The field scores label sequences (0 boilerplate, 1 content) by feature
weights and transition weights; Viterbi decoding gives the best one. The share of words in content
lines decides whether a document stays.

The field is trained here, on a bounded sample of labelled documents: lines of a document labelled
good count as content, lines of one labelled bad as boilerplate. To learn where labels change it is
also shown documents spliced from both: the lines of a bad one in the midst of those of a good one.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_text, map_text

#: Fixed values of the contract.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = "#*$%&|<>", 50, 50, 3
#: A document stays if at least this share of its words is in content lines.
MIN_CONTENT_SHARE = 0.5
#: Labelled documents that the field is trained on at most, and lines of each at most (longer ones are not drawn).
SAMPLE_DOCS, SAMPLE_LINES = 600, 200

_WHITE = " \t\n\x0b\x0c\r"
#: What a character is, as bits.
WHITE, SYMBOL, UPPER, ALPHA, DIGIT, SHOUT, PIPE = (1 << i for i in range(7))


@cache
def _kinds() -> np.ndarray:
    """The bits of every code point."""
    chars = [chr(i) for i in range(sys.maxunicode + 1)]
    table = np.fromiter((UPPER * c.isupper() | ALPHA * c.isalpha() for c in chars), np.uint8, len(chars))
    for bit, members in ((WHITE, _WHITE), (SYMBOL, SYMBOLS), (DIGIT, "0123456789"), (SHOUT, "!"), (PIPE, "|")):
        table[[ord(c) for c in members]] |= bit
    return table


@dataclass
class Counts:
    """The base counts of texts and, for each of their lines that has a word, what the features need."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    base_failed: np.ndarray
    first_line: np.ndarray  # of each text, and one more: the end
    lines: np.ndarray  # lines x (words, symbols, pipes, capitals, letters, shouts, digits, characters, repeated words, distinct words)
    flags: np.ndarray  # lines x FLAGS


def _runs(values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by runs whose lengths are n (runs of none: 0)."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def count(texts: list[str]) -> Counts:
    # bytes: only ASCII white space splits
    split = [[line.split() for line in t.encode("utf-8", "surrogatepass").split(b"\n")] for t in texts]
    per_line = np.array([len(ws) for lines in split for ws in lines], np.int64)
    doc_lines = np.array([len(lines) for lines in split], np.int64)
    words = [w for lines in split for ws in lines for w in ws]
    del split
    n_words = _runs(per_line, doc_lines)
    n = len(words)
    joined = "\n".join(texts)  # so every line ends at a break or the end
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[codes]
    breaks = np.flatnonzero(codes == 10)
    begins, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(codes)]))
    sums = {}
    for bit in (WHITE, SYMBOL, PIPE, UPPER, ALPHA, SHOUT, DIGIT):
        total = np.concatenate(([0], np.cumsum(kinds & bit != 0)))
        sums[bit] = total[ends] - total[begins]
    n_symbols, word_chars = _runs(sums[SYMBOL], doc_lines), _runs(ends - begins - sums[WHITE], doc_lines)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    del words
    of_doc = np.repeat(np.arange(len(texts)), n_words)
    covered = np.zeros(n, bool)
    if n >= WINDOW:
        pairs = np.unique((of_doc[:-1] * len(number) + ids[:-1]) * len(number) + ids[1:], return_inverse=True)[1]
        windows = np.flatnonzero(of_doc[2:] == of_doc[:-2])
        _, which, times = np.unique(pairs[windows] * len(number) + ids[windows + 2], return_inverse=True, return_counts=True)
        twice = windows[times[which] > 1]
        for k in range(WINDOW):
            covered[twice + k] = True
    n_repeat = _runs(covered, n_words)
    full = np.flatnonzero(per_line)
    size = per_line[full]
    repeated = _runs(covered, size)
    of_line = np.repeat(np.arange(len(full)), size)
    distinct = np.bincount(np.unique(of_line * max(1, len(number)) + ids) // max(1, len(number)), minlength=len(full))
    line_doc = np.repeat(np.arange(len(texts)), doc_lines)[full]
    first_line = np.searchsorted(line_doc, np.arange(len(texts) + 1))
    flags = np.zeros((len(full), len(FLAGS)), bool)
    seen: set[str] = set()
    at = -1
    for i, (d, a, b) in enumerate(zip(line_doc.tolist(), begins[full].tolist(), ends[full].tolist(), strict=True)):
        if d != at:
            at, seen = d, set()
        line = joined[a:b]
        flags[i, 0] = line in seen
        flags[i, 1] = line.rstrip()[-1:] in (".", "?", ":", '"')
        seen.add(line)
    filled = first_line[1:] > first_line[:-1]
    flags[first_line[:-1][filled], 2] = flags[first_line[1:][filled] - 1, 3] = True
    lines = np.stack([size, *(sums[k][full] for k in (SYMBOL, PIPE, UPPER, ALPHA, SHOUT, DIGIT)), (ends - begins)[full], repeated, distinct], axis=1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return Counts(n_words, word_chars, n_symbols, _runs(flags[:, 0], np.diff(first_line)), n_repeat, failed, first_line, lines, flags)


#: Bin edges of the numeric features, in the order that features() has them.
BINS = (
    ("words", (2, 4, 8, 16, 32, 64)),
    ("symbols to a word", (0.01, 0.1, 0.3, 0.6, 0.9)),
    ("pipes to a word", (0.05, 0.3, 0.6)),
    ("capitals to a letter", (0.05, 0.15, 0.4, 0.8)),
    ("exclamation marks to a word", (0.01, 0.1, 0.5)),
    ("digits to a character", (0.02, 0.1, 0.3)),
    ("characters to a word", (3.5, 5, 8, 11, 17)),
    ("words in repeated windows to a word", (0.05, 0.3, 0.7)),
    ("distinct words to a word", (0.2, 0.4, 0.6, 0.8)),
)
FLAGS = ("duplicate", "ends a sentence", "first", "last")
N_FEATURES = sum(len(b) + 1 for _, b in BINS) + len(FLAGS) + 1


@cache
def _offsets() -> tuple[int, ...]:
    return tuple(np.cumsum([0, *(len(b) + 1 for _, b in BINS)]).tolist())


def _bins(c: Counts) -> np.ndarray:
    """The number of the feature that is 1, for each line and numeric feature."""
    words, symbols, pipes, capitals, letters, shouts, digits, chars, repeated, distinct = c.lines.T.astype(float)
    raw = (words, symbols / words, pipes / words, capitals / np.maximum(letters, 1), shouts / words, digits / chars, chars / words, repeated / words, distinct / words)
    return np.stack([offset + np.searchsorted(edges, x, side="right") for offset, (_, edges), x in zip(_offsets(), BINS, raw, strict=False)], axis=1)


def features(c: Counts) -> np.ndarray:
    """A row of 0/1 features for each line with a word."""
    out = np.zeros((len(c.lines), N_FEATURES), np.float32)
    np.put_along_axis(out, _bins(c), 1, axis=1)
    out[:, _offsets()[-1] : -1] = c.flags
    out[:, -1] = 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights: features x 2 labels, and from label x to label."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, c: Counts) -> np.ndarray:
        """features(c) @ emit, without the zeros."""
        return self.emit[_bins(c)].sum(axis=1) + c.flags @ self.emit[_offsets()[-1] : -1] + self.emit[-1]

    def decode(self, scores: list[list[float]]) -> list[int]:
        """The best labels of a sequence of pairs of scores; at the end a tie goes to content."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            p0, p1 = (a + m00, 0) if a + m00 > b + m10 else (b + m10, 1), (a + m01, 0) if a + m01 > b + m11 else (b + m11, 1)
            back.append((p0[1], p1[1]))
            a, b = p0[0] + s0, p1[0] + s1
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def objective(emit: np.ndarray, move: np.ndarray, batch: Batch, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised mean conditional log-likelihood of the labels, and its gradients by emit and move.

    The likelihood of a sequence is divided by its length: a document weighs one, whatever its length.
    """
    n, longest = batch.inside.shape
    lengths, alive = batch.lengths, batch.alive
    weight = 1.0 / lengths
    u = (batch.flat @ emit.astype(batch.flat.dtype)).astype(np.float64).reshape(n, longest, 2)
    f, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    f[:, 0] = u[:, 0]
    for t in range(1, longest):
        k = alive[t]
        f[:k, t] = np.logaddexp(f[:k, t - 1, :1] + move[0], f[:k, t - 1, 1:] + move[1]) + u[:k, t]
    edge = np.zeros((2, 2))
    z = np.logaddexp(*f[np.arange(n), lengths - 1].T)
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        ahead = u[:k, t + 1] + b[:k, t + 1]
        b[:k, t] = np.logaddexp(move[None, :, 0] + ahead[:, :1], move[None, :, 1] + ahead[:, 1:])
        joint = np.exp(f[:k, t, :, None] + move[None] + ahead[:, None, :] - z[:k, None, None])
        edge += (joint * weight[:k, None, None]).sum(axis=0)
    p = np.exp(f + b - z[:, None, None]) * (batch.inside * weight[:, None])[:, :, None]
    gold = (np.take_along_axis(u, batch.labels[:, :, None], axis=2)[:, :, 0] * batch.inside).sum(axis=1)
    gold += (move[batch.labels[:, :-1], batch.labels[:, 1:]] * batch.inside[:, 1:]).sum(axis=1)
    value = float(((gold - z) * weight).mean()) - l2 / 2 * (float((emit**2).sum()) + float((move**2).sum()))
    by_emit = (batch.gold_emit - batch.flat.T @ p.reshape(-1, 2).astype(batch.flat.dtype)) / n - l2 * emit
    return value, by_emit, (batch.gold_move - edge) / n - l2 * move


class Batch:
    """Sequences side by side, the longest first, padded, with a label for each line."""

    def __init__(self, sequences: list[np.ndarray], labels: list[np.ndarray], dtype=np.float32):
        pairs = sorted(((x, y) for x, y in zip(sequences, labels, strict=True) if len(x)), key=lambda p: -len(p[0]))
        self.lengths = np.array([len(x) for x, _ in pairs])
        n, longest = len(pairs), int(self.lengths[0])
        x = np.zeros((n, longest, pairs[0][0].shape[1]), dtype)
        self.labels = np.zeros((n, longest), int)
        for i, (s, y) in enumerate(pairs):
            x[i, : len(s)], self.labels[i, : len(s)] = s, y
        self.flat = x.reshape(n * longest, -1)
        self.inside = np.arange(longest)[None, :] < self.lengths[:, None]
        self.alive = [int((self.lengths > t).sum()) for t in range(longest)]
        each = self.inside / self.lengths[:, None]
        self.gold_emit = np.stack([np.einsum("ntf,nt->f", x, each * (self.labels == v)) for v in (0, 1)], axis=1).astype(float)
        steps = each[:, 1:]
        self.gold_move = np.array([[(steps * ((self.labels[:, :-1] == v) & (self.labels[:, 1:] == w))).sum() for w in (0, 1)] for v in (0, 1)])


def train(sequences: list[np.ndarray], labels: list[np.ndarray], l2: float = 1e-3, steps: int = 80, rate: float = 0.1) -> Field:
    """Maximum conditional likelihood by Adam; labels has an array for each sequence, a label for each line.

    Without lines of both labels all weights are 0, and every line is content.
    """
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({v for y in labels for v in np.unique(y).tolist()}) < 2:
        return Field(emit, move)
    batch = Batch(sequences, labels)
    m = [np.zeros_like(emit), np.zeros_like(move)]
    s = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        _, *grads = objective(emit, move, batch, l2)
        for w, g, i in ((emit, grads[0], 0), (move, grads[1], 1)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            w += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move)


def train_on(texts: list[str], labels: list[int]) -> Field:
    """A field trained on documents labelled good (1) or bad (0), and on splices of both."""
    lines = [[x for x in t.split("\n") if x.encode("utf-8", "surrogatepass").split()] for t in texts]
    rows = [("\n".join(x), np.full(len(x), y)) for x, y in zip(lines, labels, strict=True)]
    good, bad = ([x for x, y in zip(lines, labels, strict=True) if y == v and x] for v in (1, 0))
    for a, b in zip(good[::2], bad[::2], strict=False):
        cut = (len(a) + 1) // 2
        rows.append(("\n".join([*a[:cut], *b, *a[cut:]]), np.repeat([1, 0, 1], [cut, len(b), len(a) - cut])))
    c = count([t for t, _ in rows])
    x = features(c)
    return train([x[i:j] for i, j in zip(c.first_line[:-1], c.first_line[1:], strict=True)], [y for _, y in rows])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Trains on at most sample_docs labelled rows: half of each label, those of the smallest id hash."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = None
    for value in (0, 1):
        part = marked.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").where(F.size(F.split("text", "\n")) <= sample_lines)
    got = rows.select("doc_id", "quality", "text").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    return train_on(got["text"].tolist(), got["quality"].tolist())


def content_shares(model: Field, c: Counts) -> np.ndarray:
    """Of each text, the share of its words that is in content lines; 0 without words."""
    scores, words = model.scores(c).tolist(), c.lines[:, 0].tolist()
    shares = np.zeros(len(c.n_words))
    for i, (a, b) in enumerate(zip(c.first_line[:-1].tolist(), c.first_line[1:].tolist(), strict=True)):
        content = sum(w for w, label in zip(words[a:b], model.decode(scores[a:b]), strict=True) if label)
        shares[i] = content / max(1, sum(words[a:b]))
    return shares


def quality_rules(df: DataFrame, model: Field, min_content_share: float = MIN_CONTENT_SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    A null or empty text has no words and fails the base rules. Null ids and repeated rows pass
    through row by row; an empty table gives no rows; other columns of df are ignored.
    """

    def make():
        def run(texts):
            c = count(texts)
            shares = content_shares(model, c)
            return [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, shares, ~c.base_failed & (shares >= min_content_share)]

        return run

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return map_text(df, make, fields, text, [doc_id])


def keep_quality(df: DataFrame, model: Field, min_content_share: float = MIN_CONTENT_SHARE, text: str = "text") -> DataFrame:
    """The rows of df, with all columns, that quality_rules() keeps.

    Null, empty and wordless texts fail the base rules and go; long texts are read whole; repeated rows
    stay or go together; an empty table stays empty; other columns stay as they are, whatever their names.
    """

    def make():
        def run(texts):
            c = count(texts)
            return ~c.base_failed & (content_shares(model, c) >= min_content_share)

        return run

    return filter_text(df, make, text)
