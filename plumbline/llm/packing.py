"""Cost-balanced packing of documents into training sequences.

A sequence of L tokens that holds pieces of l1, l2, ... tokens costs sum(a * l + b * l^2): a linear
part for the dense layers and a quadratic one for attention within each piece. Documents longer than
a sequence give whole sequences; what is left, and the shorter documents, go in descending length
each to the sequence of the lowest cost that still has room. The number of sequences is the least
that holds the tokens, so near the end a document may fit nowhere whole: it is then cut over the
sequences with the most room. Only one sequence of a group is not full.

Groups are runs of rows of a task, closed at GROUP_TOKENS: tokens are counted, kept and packed in
one pass and without a shuffle, in memory bounded by a group and the longest document.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import spread, text_or_empty

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 8_000_000
END_ID = 1


@cache
def _encoder(ranks_path: str, special: tuple[tuple[str, int], ...], pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@cache
def _library(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def byte_bpe_ids(text: str, json_path: str, ranks_path: str | None, pattern: str | None) -> np.ndarray:
    """The ids that the tokenizers library gives for the vocabulary at json_path.

    ranks_path names the same vocabulary as ranks: a faster library then gives the same ids. A text
    that its pattern matcher gives up on goes to the first library.
    """
    if ranks_path:
        special = tuple((t.content, i) for i, t in _library(json_path).get_added_tokens_decoder().items())
        try:
            return _encoder(ranks_path, special, pattern).encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except BaseException as e:  # a panic in native code is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.array(_library(json_path).encode(text, add_special_tokens=False).ids, np.uint32)


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); every token is in one piece.

    Ties in length go by position, ties in cost to the earlier sequence. A length of 0 has no piece.
    """
    whole: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole += [[(d, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    rest.sort(key=lambda p: -p[2])
    count = -(-sum(p[2] for p in rest) // capacity)
    made: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room, cost = [capacity] * count, [0.0] * count
    # A heap of (cost, sequence) for each amount of room, and a tree of the least top over the amounts.
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, s) for s in range(count)]
    size = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * size)

    def refresh(r: int) -> None:
        i = size + r
        tree[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(least: int) -> int:
        a, b, best = size + least, 2 * size, none
        while a < b:
            if a & 1:
                best, a = min(best, tree[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, tree[b])
            a, b = a >> 1, b >> 1
        return best[1]

    def put(s: int, d: int, start: int, n: int) -> None:
        heapq.heappop(heaps[room[s]])
        refresh(room[s])
        made[s].append((d, start, n))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        heapq.heappush(heaps[room[s]], (cost[s], s))
        refresh(room[s])

    if count:
        refresh(capacity)
    most = capacity
    for d, start, n in rest:
        while n:
            if (s := cheapest(n)) >= 0:
                put(s, d, start, n)
                break
            while not heaps[most]:  # room only shrinks
                most -= 1
            s = heaps[most][0][1]
            part = room[s]
            put(s, d, start, part)
            start, n = start + part, n - part
    return whole + made


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    df: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the ids themselves. A document's tokens are its ids and END_ID, so a null or empty
    text has one. Null ids and repeated rows are packed row by row; an empty table gives no rows;
    other columns of df are ignored. sequence_id is unique over the result.

    Which documents share a group, and so where they are cut and what the sequences are called, follows
    the partitions of df: another number of files or cores gives another packing, as good.
    """
    fields = T.StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else ""))
    src = spread(df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text")))
    schema = T.StructType([src.schema["doc_id"], *fields])

    def packed(docs: list[tuple[object, np.ndarray]], base: int) -> Iterator[pa.RecordBatch]:
        sequences = assign([len(ids) for _, ids in docs], capacity, linear, quadratic)
        rows = []
        for k, pieces in enumerate(sequences):
            at = 0
            for d, start, n in pieces:
                name, ids = docs[d]
                part = ids[start : start + n].astype("<u4")
                rows.append((name, start, n, zlib.crc32(part.tobytes()), len(ids), base + k, at, *((part.astype(np.int32),) if with_ids else ())))
                at += n
        names = ["doc_id", *fields.names]
        for a in range(0, len(rows), 20_000):
            cols = zip(*rows[a : a + 20_000], strict=True)
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, cols), strict=True)), schema=arrow)

    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        docs, held = [], 0
        for batch in batches:
            for name, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = byte_bpe_ids(t.as_py(), json_path, ranks_path, pattern)
                docs.append((name.as_py(), np.append(ids, np.uint32(END_ID))))
                held += len(ids) + 1
                if held >= group_tokens:
                    yield from packed(docs, base)
                    base, docs, held = base + held, [], 0  # no more sequences than tokens
        if docs:
            yield from packed(docs, base)

    return src.mapInArrow(run, schema)
