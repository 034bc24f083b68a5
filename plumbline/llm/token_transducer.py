"""Token counts by a compiled finite-state tokenizer.

Merge-type tokenization is local: a sequence of tokens is the tokenization of its text exactly if
every two neighbours are the tokenization of theirs. So a text's tokenization can be followed from
left to right with finitely many states, and this module compiles it, as far as texts ask for it,
into a deterministic transducer over characters.

A state holds the open runs: for each place to the left from which a vocabulary piece may still run
past the current place, the run's node in the trie of pieces, the last token of the tokenization up
to the run, and the tokens that the current prefix has more. Reading a character moves all runs;
the one piece that ends here and agrees with the token before its run is the new last token (else
the character alone is). The transition is annotated with the change of the number of tokens, which
may be negative: a merge takes tokens back.

Between characters that no vocabulary token has side by side the tokenization always splits, and the
state after the second one depends on nothing before. Texts are cut in chunks; a chunk's state map
is constant from its first such place on, so a map is a pending head (the characters before it) and
a constant exit state with a count. Maps compose associatively: composing two runs the second's head
from the first's exit state. Chunks of all texts step through the transducer in lockstep and their
maps are composed pairwise in a parallel scan of logarithmic depth.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

SPACE = "▁"
CHUNK = 256
LIMIT = 4096
#: Bytes that the transition tables of a task hold at most before they are compiled anew.
TABLE_BYTES = 140 << 20
#: A node with no more pieces below it than this has its runs told apart only by what can follow.
FEW_PIECES = 4


class Vocabulary:
    """Pieces and merge priorities of a merge-type model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        self.rank: dict[str, int] = {}
        self.id: dict[str, int] = {}
        for i in range(lib.get_piece_size()):
            if lib.is_byte(i):
                continue
            piece = lib.id_to_piece(i)
            self.id[piece] = i
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.rank[piece] = -lib.get_score(i)

    def normalized(self, text: str) -> str:
        """What the library segments: white space marked, a mark in front, its own character map applied."""
        return self.library.normalize(text) if text else ""

    def merge(self, text: str) -> list[str]:
        """The tokenization of a short string, unknown characters as they are."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best = min(((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(np.inf, 0))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts


class Transducer:
    """The transducer over characters, compiled as far as texts have asked for.

    State 0 is the one after a sure split, before any character is read.
    """

    def __init__(self, vocabulary: Vocabulary, table_bytes: int = TABLE_BYTES):
        self.v = vocabulary
        self.table_bytes = table_bytes
        long = sorted(p for p in vocabulary.rank if len(p) > 1)
        self.pairs = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.chars = ["", *sorted({c for p in long for c in p})]
        self.class_of = np.zeros(0x110000, np.int16)  # class 0: characters that only stand alone
        self.class_of[[ord(c) for c in self.chars[1:]]] = np.arange(1, len(self.chars))
        self.side_by_side = np.zeros((len(self.chars),) * 2, bool)
        for p in self.pairs:
            self.side_by_side[self.class_of[ord(p[0])], self.class_of[ord(p[1])]] = True
        self.alone = np.array([1 if chr(c) in vocabulary.id else len(chr(c).encode("utf-8", "surrogatepass")) for c in range(0x110000)], np.int8)
        # Trie of the pieces of two characters and more.
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in long:
            node = 0
            for c in p:
                to = self.child[node].get(c)
                if to is None:
                    to = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                node = to
            self.piece[node] = p
        # The pieces at and below a node, where they are few.
        self.below: list[tuple[str, ...] | None] = [()] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):  # children come after their parents
            found = [self.below[to] for to in self.child[node].values()]
            own = (self.piece[node],) if self.piece[node] else ()
            self.below[node] = None if None in found or sum(map(len, found)) >= FEW_PIECES else sum(found, own)
        self.reset()

    def reset(self) -> None:
        """Forgets the compiled states."""
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.column = np.full(len(self.chars), -1, np.int32)  # of the tables, by class
        self.column[0] = 0
        self.columns = 1
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)
        self.known: dict[tuple, bool] = {}
        self.like: dict[tuple, str | None] = {}

    def _agree(self, before: str | None, piece: str) -> bool:
        """Whether the piece is a token that can follow the token before it."""
        key = (before, piece)
        got = self.known.get(key)
        if got is None:
            tokens = [piece] if before is None else [before, piece]
            got = self.known[key] = self.v.merge("".join(tokens)) == tokens
        return got

    def _alike(self, node: int, before: str | None) -> str | None | bool:
        """The first token met that the pieces below a node follow as they follow this; False if none can."""
        pieces = self.below[node]
        if pieces is None:
            return before
        agree = tuple(self._agree(before, p) for p in pieces if p is not self.piece[node])
        return self.like.setdefault((node, agree), before) if any(agree) else False

    def _step(self, runs: tuple, c: str) -> tuple[tuple, int]:
        """The runs after reading c, and the change of the number of tokens."""
        last, gained, grown = c, 1, []
        for node, before, since in runs:
            if node == 0 and before is not None and before[-1] + c not in self.pairs:
                before = None  # a sure split: what is left of it does not matter
            to = self.child[node].get(c)
            if to is not None:
                p = self.piece[to]
                if p is not None and self._agree(before, p):
                    last, gained = p, 1 - since
                if self.child[to] and (before := self._alike(to, before)) is not False:
                    grown.append((to, before, since))
        return (*sorted((n, b or "", s + gained) for n, b, s in grown), (0, last, 0)), gained

    def compile(self, state: int, cls: int) -> None:
        """Adds the transition of a state by a class."""
        if self.column[cls] < 0:
            if self.columns == self.next.shape[1]:
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)), axis=1)
                self.emit = np.concatenate((self.emit, np.zeros_like(self.emit)), axis=1)
            self.column[cls] = self.columns
            self.columns += 1
        if cls == 0:
            key, gained = self.states[0], 0  # alone[] has what it emits
        else:
            runs = tuple((n, b or None, s) for n, b, s in self.states[state])
            key, gained = self._step(runs, self.chars[cls])
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            if target == len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.emit = np.concatenate((self.emit, np.zeros_like(self.emit)))
        self.next[state, self.column[cls]] = target
        self.emit[state, self.column[cls]] = gained

    def run(self, classes: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps through many stretches of classes in lockstep; states and counts at their ends."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        at, now, count = begin[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        for n in alive.tolist():
            cls = classes[at[:n]]
            col = self.column[cls]
            flat = now[:n] * self.next.shape[1] + col
            to = np.where(col < 0, -1, self.next.ravel().take(flat, mode="clip"))
            if (miss := np.flatnonzero(to < 0)).size:
                for pair in np.unique(now[miss] * len(self.chars) + cls[miss]).tolist():
                    self.compile(*divmod(pair, len(self.chars)))
                flat = now[:n] * self.next.shape[1] + self.column[cls]
                to = self.next.ravel().take(flat)
            count[:n] += self.emit.ravel().take(flat)
            now[:n] = to
            at[:n] += 1
        states, counts = np.empty_like(now), np.empty_like(count)
        states[order], counts[order] = now, count
        return states, counts

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each normalized text."""
        if self.next.nbytes > self.table_bytes:
            self.reset()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        classes = self.class_of[codes]
        alone = np.concatenate(([0], np.cumsum(np.where(classes == 0, self.alone[codes], 0))))
        out = alone[ends] - alone[ends - size]
        if not len(codes):
            return out
        split = np.ones(len(codes), bool)  # the tokenization surely splits before this character
        split[1:] = ~self.side_by_side[classes[:-1], classes[1:]]
        split[(ends - size)[size > 0]] = True
        # Chunks, the state map of each, and their composition.
        pieces = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(texts)), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (ends - size)[doc] + k * CHUNK
        end = np.minimum(begin + CHUNK, ends[doc])
        places = np.append(np.flatnonzero(split), len(codes))
        body = np.minimum(places[np.searchsorted(places, begin)], end)
        exit_, count = self.run(classes, body, end, np.zeros(len(doc), np.int64))
        exit_[body == end] = -1  # no sure split: all of it is a pending head
        head = begin
        while len(doc) > 1 and (doc[1:] == doc[:-1]).any():
            first = np.searchsorted(doc, doc)
            a = np.flatnonzero(((np.arange(len(doc)) - first) % 2 == 0) & np.append(doc[1:] == doc[:-1], False))
            b = a + 1
            ready = exit_[a] >= 0
            ra, rb = a[ready], b[ready]
            state, more = self.run(classes, head[rb], body[rb], exit_[ra])
            count[ra] += more + count[rb]
            exit_[ra] = np.where(exit_[rb] >= 0, exit_[rb], state)
            wa, wb = a[~ready], b[~ready]
            body[wa], exit_[wa], count[wa] = body[wb], exit_[wb], count[wb]
            left = np.setdiff1d(np.arange(len(doc)), b, assume_unique=True)
            doc, head, body, exit_, count = (x[left] for x in (doc, head, body, exit_, count))
        np.add.at(out, doc, count)
        return out


@cache
def _transducer(model_path: str) -> Transducer:
    return Transducer(Vocabulary(model_path))


def count_tokens(df: DataFrame, model_path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    The counts are those of the library for the model, without added tokens. A null or empty text has
    none. Null ids and repeated rows pass through row by row; an empty table gives no rows; other
    columns of df are ignored.
    """

    def make():
        t = _transducer(model_path)

        def run(texts):
            n = t.count([t.v.normalized(x) for x in texts])
            return [[len(x.encode("utf-8", "surrogatepass")) for x in texts], n, n > limit]

        return run

    return map_text(df, make, "n_bytes long, n_tokens long, over_limit boolean", text, [doc_id])
