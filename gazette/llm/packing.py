"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n + QUADRATIC * n * n to train on. Pieces go, dearest
first, to the cheapest sequence that has room; where no sequence has, the piece
is cut and fills the sequence with most room. The sequences of a group hold
exactly its tokens: as many full ones as fit and, for the rest, sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gazette.llm.files import partition_id
from gazette.llm.tokens import pieces_of

CAPACITY = 2048
END_ID = 1
#: Attention grows with the square: a full sequence pays as much for it as for everything else.
QUADRATIC = 1 / CAPACITY
#: Tokens packed together; a task holds one such group and the text it comes from.
GROUP_TOKENS = 1 << 21
_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def capacities(tokens: int, capacity: int = CAPACITY) -> np.ndarray:
    """Room of the sequences for so many tokens: full ones, then the powers of two that make up the rest."""
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def pack(lengths: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; equal costs go by document and place."""
    room = capacities(sum(lengths), capacity)
    size, cost = room.copy(), np.zeros(len(room))
    queue = []
    for doc, n in enumerate(lengths):
        for start in range(0, n, capacity):
            queue.append((-min(capacity, n - start), doc, start))
    heapq.heapify(queue)
    out = []
    while queue:
        negative, doc, start = heapq.heappop(queue)
        n = -negative
        fit = np.flatnonzero(room >= n)
        if len(fit):
            to = int(fit[np.argmin(cost[fit])])
        else:
            to = int(np.argmax(room))
            heapq.heappush(queue, (-(n - int(room[to])), doc, start + int(room[to])))
            n = int(room[to])
        out.append((doc, start, n, to, int(size[to] - room[to])))
        room[to] -= n
        cost[to] += n + quadratic * n * n
    return out


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its token ids and `end_id`; null and empty texts are the end
    id alone. Rows are packed in the partitions they lie in, group by group, so
    nothing is shuffled and a task holds one group at a time; a longer document
    makes a group of its own. Sequence numbers are unique and depend on the
    partition. Null and repeated ids are kept as they are; other columns are
    not read. The capacity must be a power of two.
    """
    schema = StructType([docs.schema[doc_id], *(StructField(c, LongType()) for c in _COLUMNS)])
    if with_ids:
        schema = StructType([*schema, StructField("ids", ArrayType(IntegerType()))])
    names = ["doc_id", *_COLUMNS, *(["ids"] if with_ids else [])]
    schema.fields[0].name = schema.names[0] = "doc_id"

    def run(batches):
        tokenizer = pieces_of(path)
        first_sequence = partition_id() << 40

        def flush(keys: list, parts: list[np.ndarray]):
            nonlocal first_sequence
            rows = pack([len(p) for p in parts], capacity)
            used = max(r[3] for r in rows) + 1
            docs_of = [r[0] for r in rows]
            cut = [parts[d][s : s + n] for d, s, n, _, _ in rows]
            columns = [
                pa.array([keys[d] for d in docs_of], key_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()), pa.array([len(parts[d]) for d in docs_of], pa.int64()),
                pa.array([first_sequence + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32), pa.array(np.concatenate(cut).astype(np.int32))))
            first_sequence += used
            return pa.RecordBatch.from_arrays(columns, names=names)

        keys, parts, held, key_type = [], [], 0, None
        for batch in batches:
            key_type = batch.column(0).type
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids_of), 256):
                flat, first = tokenizer.encode([t or "" for t in texts.slice(a, 256).to_pylist()])
                for i in range(len(first) - 1):
                    own = np.append(flat[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    if parts and held + len(own) > group_tokens:
                        yield flush(keys, parts)
                        keys, parts, held = [], [], 0
                    keys.append(ids_of[a + i])
                    parts.append(own)
                    held += len(own)
        if parts:
            yield flush(keys, parts)

    return docs.select(doc_id, text).mapInArrow(run, schema)
