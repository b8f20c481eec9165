"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

Each task packs its own documents, window by window, so nothing is shuffled and no more than a window is held. Within a
window a document's full sequences are cut off first; the remainders, in descending order of cost (linear plus quadratic
attention), go to the sequence of least cost that still has room. A remainder for which no sequence has room is cut over
the roomiest, so a window wastes less than one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest
from .tok import encoder

#: A window is packed once it holds as many tokens, or as many documents.
WINDOW_TOKENS, WINDOW_DOCS = 1 << 20, 1 << 14


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) of each piece, and the number of sequences.

    Costs are linear * n + quadratic * n * n / capacity for a piece of n tokens.
    """
    out, rest, used = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((doc, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    cost, room = np.zeros(bins), np.full(bins, capacity)

    def put(k: int, doc: int, start: int, n: int) -> None:
        out.append((doc, start, n, used + k, int(capacity - room[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n / capacity

    for n, doc, start in rest:
        k = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[k] >= n:
            put(k, doc, start, n)
            continue
        while n:
            k = int(np.argmax(room))
            part = min(n, int(room[k]))
            put(k, doc, start, part)
            start, n = start + part, n - part
    return out, used + bins


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", linear: float = 1.0, quadratic: float = 1.0) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id, offset.

    Every document is its token ids and then end_id; a null or empty text is end_id alone. Repeated rows and null keys
    are packed as often as they come. Sequence ids are unique over the result; offsets run gapless from 0. Other columns
    are dropped; an empty table gives no rows. Ids are those of `tokenizers`; for Latin-1 texts a second library over the
    same ranks gives them where it can be imported and agrees, on every Latin-1 character in context and on the first
    texts of each worker (tok.Encoder.ranked); else all go through `tokenizers`, with the same result.
    """
    schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True)
        base = TaskContext.get().partitionId() << 36
        keys, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            pieces, used = assign([len(x) // 4 for x in ids], capacity, linear, quadratic)
            for at in range(0, len(pieces), 8192):
                rows = pieces[at : at + 8192]
                cols = [[keys[p[0]] for p in rows], [p[1] for p in rows], [p[2] for p in rows], [ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in rows], [len(ids[p[0]]) // 4 for p in rows], [base + p[3] for p in rows], [p[4] for p in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, f.type) for c, f in zip(cols[1:], schema, strict=True))], ["key", *schema.names])
            base += used
            keys.clear()
            ids.clear()
            held = 0

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                ids.append(own.encode(t) + end)
                held += len(ids[-1]) // 4
                if held >= WINDOW_TOKENS or len(ids) >= WINDOW_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    modest(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(packed, f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
        .withColumnRenamed("key", key)
    )
