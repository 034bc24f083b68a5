"""Merge-type encoding with seeded merge dropout, and lossless decoding.

Encoding merges neighbouring pieces, best merge first, from an agenda. With dropout, a candidate
merge that comes up is skipped for good if a keyed hash of it falls below the rate. The hash is of
the seed, the document's key, the occurrence of the word in it, and the candidate's three borders, so
the result depends on neither machine nor order of work, and every occurrence is cut on its own. The
plain encoding of a word is made once and remembered with the borders of its merges; an occurrence
that skips none of them has that encoding, any other is encoded anew, and so is a word met once.

No merge crosses the start of a word (a mark after a character that is none), so words are encoded
on their own: long ones from an agenda, short ones many at a time, each by its best candidate in
every round. Rate 0 gives the library's own encoding, but for one case: a mark that stands in the
text itself is encoded as its bytes, so that it isn't decoded as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_or_empty
from .token_transducer import SPACE, Vocabulary

RATE, SEED = 0.1, 42
#: Words whose encodings a task remembers at most; longer words than SHORT are encoded one by one.
CACHE_WORDS, SHORT = 400_000, 64
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MASK = (1 << 64) - 1
#: Fixed odd numbers of a 64-bit mixing function.
_A, _M, _B, _X, _Y = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class _Pairs:
    """From two neighbouring pieces' ids to the id of the piece they merge to, for arrays."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.id
        found = [(ids[p[:i]], ids[p[i:]], ids[p]) for p in vocabulary.rank for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        left, right, merged = np.array(found or [(0, 0, 0)], np.int64).T
        self.bits = max(4, len(found).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, at = left << 32 | right, self._slot(left << 32 | right)
        while len(keys):
            free = self.keys[at] < 0
            first = np.unique(np.where(free, at, -1), return_index=True)
            put = first[1][first[0] >= 0]
            self.keys[at[put]], self.values[at[put]] = keys[put], merged[put]
            left_over = np.setdiff1d(np.arange(len(keys)), put)
            keys, merged, at = keys[left_over], merged[left_over], (at[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Codec:
    def __init__(self, vocabulary: Vocabulary, rate: float = RATE, seed: int = SEED):
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary.rank):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self.v, self.seed = vocabulary, seed
        self.limit = int(rate * (1 << 64))
        lib = vocabulary.library
        n = lib.get_piece_size()
        self.byte_id = {i: lib.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self.bytes = [lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.pairs = _Pairs(vocabulary)
        self.char_id = np.full(0x110000, -1, np.int32)
        self.rank_of = np.zeros(n, np.int32)
        places = {r: k for k, r in enumerate(sorted(set(vocabulary.rank.values())))}
        for p, i in vocabulary.id.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            if p in vocabulary.rank:
                self.rank_of[i] = places[vocabulary.rank[p]]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.seen: set[str] = set()
        self.starts, self.ends, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.merges, self.merge_ends = np.zeros(0, np.uint64), np.zeros(1, np.int64)

    def occurrence_keys(self, key: str, n: int) -> np.ndarray:
        """The keys of the n words of a document."""
        h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), self.seed & _MASK)
        x = (np.arange(n, dtype=np.uint64) + np.uint64(h)) * np.uint64(_A)
        x = (x ^ x >> np.uint64(30)) * np.uint64(_X)
        return x ^ x >> np.uint64(27)

    def _skipped(self, x: np.ndarray) -> np.ndarray:
        """Which candidates are skipped; x is the key of the occurrence ^ the hash of the borders."""
        x = (x ^ x >> np.uint64(31)) * np.uint64(_X)
        x = (x ^ x >> np.uint64(29)) * np.uint64(_Y)
        return (x ^ x >> np.uint64(32)) < np.uint64(min(self.limit, _MASK))

    def pieces(self, word: str, key: int | None, merges: list[int] | None = None) -> list[str]:
        """The pieces of a word; the agenda holds (rank, start, middle, end) of candidates.

        No key stands for no dropout. The borders' hashes of what is merged are added to merges.
        """
        n = len(word)
        rank, limit = self.v.rank, self.limit
        end = list(range(1, n + 1))  # of the piece that starts here, 0 if none does
        start = list(range(-1, n))  # of the piece before the one that starts here
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, m, b = heapq.heappop(agenda)
            if end[a] != m or end[m] != b:
                continue  # one of the two has been merged meanwhile
            borders = (a * _A + m * _M + b * _B) & _MASK
            if limit and key is not None:
                x = key ^ borders
                x = ((x ^ x >> 31) * _X) & _MASK
                x = ((x ^ x >> 29) * _Y) & _MASK
                if x ^ x >> 32 < limit:
                    continue
            if merges is not None:
                merges.append(borders)
            end[a], end[m] = b, 0
            if b < n:
                start[b] = a
                if (r := rank.get(word[a : end[b]])) is not None:
                    heapq.heappush(agenda, (r, a, b, end[b]))
            if a:
                p = start[a]
                if (r := rank.get(word[p:b])) is not None:
                    heapq.heappush(agenda, (r, p, a, b))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def _piece_ids(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.v.id.get(p)
            ids += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")] if i is None else [i]
        return ids

    def _rounds(self, words: list[str], key: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(word, id) of the pieces of short words, (word, borders' hash) of their merges if plain; a character that is no piece gives its bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int32, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        start = np.arange(len(codes), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
        ids = self.char_id[codes]
        ids[ids < 0] = -2 - codes[ids < 0].astype(np.int32)
        end = start + np.int32(1)
        none = np.int32((1 << 31) - 1)
        done, merges = [], [(np.zeros(0, np.int32), np.zeros(0, np.uint64))]
        # What a piece and the next one merge to, and its rank << 6 | start; only neighbours of a merge change.
        best, merged = np.full(len(word), none), np.full(len(word), -1, np.int32)

        def borders_of(i):
            return start[i].astype(np.uint64) * np.uint64(_A) + end[i].astype(np.uint64) * np.uint64(_M) + end[i + 1].astype(np.uint64) * np.uint64(_B)

        fresh = np.arange(len(word))
        while len(word):
            fresh = fresh[fresh < len(word) - 1]
            best[fresh] = none
            fresh = fresh[word[fresh] == word[fresh + 1]]
            to = self.pairs(ids[fresh], ids[fresh + 1])
            some = to >= 0
            fresh, to = fresh[some], to[some]
            if self.limit and key is not None and len(fresh):
                kept = ~self._skipped(key[word[fresh]] ^ borders_of(fresh))
                fresh, to = fresh[kept], to[kept]
            best[fresh], merged[fresh] = self.rank_of[to] << 6 | start[fresh], to
            best[-1] = none
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(best, first)
            count = np.diff(np.append(first, len(word)))
            over = np.repeat(least == none, count)
            if over.any():
                done.append((word[over], start[over], ids[over]))
            at = np.flatnonzero((best == np.repeat(least, count)) & ~over)
            if key is None:
                merges.append((word[at], borders_of(at)))
            ids[at], end[at] = merged[at], end[at + 1]
            changed = np.zeros(len(word), bool)
            changed[at] = changed[at[at > 0] - 1] = True
            over[at + 1] = True
            left = ~over
            word, start, end, ids, best, merged, changed = (x[left] for x in (word, start, end, ids, best, merged, changed))
            fresh = np.flatnonzero(changed)
        word, start, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word.astype(np.int64) << 6 | start, kind="stable")
        of, borders = (np.concatenate(x) for x in zip(*merges, strict=True))
        by_word = np.argsort(of, kind="stable")
        word, ids = word[order], ids[order]
        if (none_ids := np.flatnonzero(ids < -1)).size:
            spelt = [[self.byte_id[b] for b in chr(-2 - c).encode("utf-8", "surrogatepass")] for c in ids[none_ids].tolist()]
            n = np.ones(len(ids), np.int64)
            n[none_ids] = list(map(len, spelt))
            starts = np.cumsum(n) - n
            word, ids = np.repeat(word, n), np.repeat(ids, n)
            ids[np.repeat(starts[none_ids] - np.cumsum(n[none_ids]) + n[none_ids], n[none_ids]) + np.arange(n[none_ids].sum())] = np.concatenate(spelt)
        return word, ids, of[by_word], borders[by_word]

    def _made(self, words: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Starts, ends and ids of words, and how many merges each has and the hashes of their borders, if plain."""
        starts, ends = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        short, singly, made = np.flatnonzero(size <= SHORT), (size > SHORT).nonzero()[0].tolist(), np.zeros(0, np.int32)
        of, borders = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(short):
            word, made, of, borders = self._rounds([words[i] for i in short.tolist()], None if keys is None else keys[short])
            of = short[of]
            cuts = np.searchsorted(word, np.arange(len(short) + 1))
            starts[short], ends[short] = cuts[:-1], cuts[1:]
        more, at, more_of, more_borders = [], len(made), [], []
        for i in singly:
            merges: list[int] = []
            more += (ids := self._piece_ids(self.pieces(words[i], None if keys is None else int(keys[i]), merges)))
            starts[i], ends[i] = at, at + len(ids)
            at += len(ids)
            if keys is None:
                more_of += [i] * len(merges)
                more_borders += merges
        of, borders = np.concatenate((of, np.array(more_of, np.int64))), np.concatenate((borders, np.array(more_borders, np.uint64)))
        return starts, ends, np.concatenate((made, np.array(more, np.int32))), np.bincount(of, minlength=len(words)), borders[np.argsort(of, kind="stable")]

    def _learn(self, words: list[str]) -> None:
        """Appends the plain ids and the merges of new words to the store, in order."""
        starts, ends, ids, n, borders = self._made(words, None)
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        self.starts, self.ends = np.concatenate((self.starts, starts + base)), np.concatenate((self.ends, ends + base))
        self.merges = np.concatenate((self.merges, borders))
        self.merge_ends = np.concatenate((self.merge_ends, self.merge_ends[-1] + np.cumsum(n)))

    def encode_batch(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The ids of each text; its key names the document in the hashes."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        every, at, cut = [], [np.zeros(0, np.uint64)], [0]
        for text, key in zip(texts, keys, strict=True):
            words = [] if SPACE in text else _WORD.findall(self.v.normalized(text))
            every += words
            at.append(self.occurrence_keys(key, len(words)))
            cut.append(len(every))
        occurrence = np.concatenate(at)
        number: dict[str, int] = _Numbers()
        of_word = np.array([number[w] for w in every], np.int64)
        places, new = [], []
        for w, n in zip(number, np.bincount(of_word, minlength=len(number)).tolist(), strict=True):
            place = self.known.get(w, -1)
            if place < 0 and (n > 1 or not self.limit or w in self.seen):
                place = self.known[w] = len(self.known)
                new.append(w)
            elif place < 0:  # a word met once is cut for that occurrence only
                self.seen.add(w)
            places.append(place)
        if new:
            self._learn(new)
        numbers = np.array(places, np.int64)[of_word] if every else of_word
        once, had = np.flatnonzero(numbers < 0), np.flatnonzero(numbers >= 0)
        starts, ends, ids = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), self.ids
        starts[had], ends[had] = self.starts[numbers[had]], self.ends[numbers[had]]
        if self.limit and len(every):
            first = self.merge_ends[numbers[had]]
            n = self.merge_ends[numbers[had] + 1] - first
            of = np.repeat(had, n)
            borders = self.merges[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
            hit = of[self._skipped(occurrence[of] ^ borders)]
            anew = np.concatenate((once, hit[np.append(True, hit[1:] != hit[:-1])[: len(hit)]]))
            if len(anew):
                a, b, made, *_ = self._made([every[i] for i in anew.tolist()], occurrence[anew])
                starts[anew], ends[anew], ids = a + len(ids), b + len(ids), np.concatenate((ids, made))
        out = []
        for text, key, a, b in zip(texts, keys, cut[:-1], cut[1:], strict=True):
            if SPACE in text:
                out.append(self._marked(text, key))
                continue
            size = ends[a:b] - starts[a:b]
            out.append(ids[np.arange(size.sum()) + np.repeat(starts[a:b] - np.cumsum(size) + size, size)])
        return out

    def _marked(self, text: str, key: str) -> np.ndarray:
        """The ids of a text that has marks of its own: they stand apart, as bytes."""
        parts = text.split(SPACE)
        own = np.array([self.byte_id[b] for b in SPACE.encode()], np.int32)
        out = []
        for k, part in enumerate(parts):
            if k:
                out.append(own)
            for j, w in enumerate(_WORD.findall(self.v.normalized(part) if not k else part.replace(" ", SPACE))):
                occurrence = xxhash.xxh64_intdigest(f"{key}:{k}:{j}".encode("utf-8", "surrogatepass"), self.seed & _MASK)
                out.append(np.array(self._piece_ids(self.pieces(w, occurrence)), np.int32))
        if not parts[0]:
            out.insert(0, np.array([self.v.id[SPACE]], np.int32))
        return np.concatenate(out)

    def encode(self, text: str, key: str = "") -> list[int]:
        return self.encode_batch([text], [key])[0].tolist()

    def decode(self, ids) -> str:
        """The text whose ids these are, whatever merges were skipped."""
        raw = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return raw[1:] if raw.startswith(" ") else raw


@cache
def _codec(model_path: str, rate: float, seed: int) -> Codec:
    return Codec(Vocabulary(model_path), rate, seed)


def encode_documents(
    df: DataFrame,
    model_path: str,
    rate: float = RATE,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id and ids (array of int) of each row.

    A null or empty text has no ids. Rows with equal ids and texts are encoded alike, a null id like
    the empty key; an empty table gives no rows; other columns of df are ignored.
    """
    return _encoded(df, model_path, rate, seed, doc_id, text, "ids array<int>", lambda codec, text, ids: (ids,))


def decode_documents(df: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null or empty ids give the empty text."""
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        codec = _codec(model_path, 0.0, SEED)
        for b in batches:
            texts = [codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(df: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and lossless of each row.

    lossless says that decoding the ids gives the whole text back. Rows are treated as by
    encode_documents().
    """

    def digest(codec, text, ids):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), codec.decode(ids.tolist()) == text

    return _encoded(df, model_path, rate, seed, doc_id, text, "n_tokens long, ids_crc32 long, lossless boolean", digest)


def _encoded(df, model_path, rate, seed, doc_id, text, fields, columns) -> DataFrame:
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))

    def make():
        codec = _codec(model_path, rate, seed)

        def run(texts, names):
            ids = codec.encode_batch(texts, ["" if x is None else str(x) for x in names])
            return [list(c) for c in zip(*(columns(codec, t, i) for t, i in zip(texts, ids, strict=True)), strict=True)]

        return run

    return map_text(src, make, fields, "text", ["doc_id"], ["doc_id"])
