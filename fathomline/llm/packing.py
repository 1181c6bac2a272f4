"""Cost-balanced sequence packing.

A piece of n tokens is taken to cost ``linear * n + quadratic * n * n`` (attention within the piece). Every document first
gives whole sequences of ``capacity`` tokens; what remains of each is assigned in descending cost to the lowest-cost
sequence that has tokens left, and is cut there if it doesn't fit, its rest being assigned likewise. As many sequences are opened as the tokens
need, so the padding is under one sequence for each shard of ``shard_tokens`` tokens.

Shards are filled while a partition's rows stream by: ids are made, packed and digested in one place, nothing is
shuffled, memory is bounded by the shard, and a lost task is simply run again. Sequence numbers are made unique by the partition number.

Defined cases: null text counts as empty and gives the end token only; identifiers may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    pieces, rests, sequence = [], [], 0
    for k, n in enumerate(lengths):
        whole = n // capacity
        for i in range(whole):
            pieces.append((k, i * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, k, whole * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    opened = -(-sum(r[0] for r in rests) // capacity)
    heap = [(0.0, sequence + i, 0) for i in range(opened)]  # cost, sequence, tokens used
    for n, k, start in rests:
        while n:
            cost, at, used = heapq.heappop(heap)
            take = min(n, capacity - used)
            pieces.append((k, start, take, at, used))
            used += take
            if used < capacity:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, at, used))
            n, start = n - take, start + take
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, encode: Callable[[str], list[int]], *, text: str = "text", id: str = "doc_id", capacity: int = 1024, end_id: int = 0, shard_tokens: int = 8 << 20, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece; see the module's text."""

    def run(batches):
        from pyspark import TaskContext

        base, opened = TaskContext.get().partitionId() << 33, 0
        docs_held: list[tuple] = []
        total = 0

        def flush():
            nonlocal opened
            pieces = pack([len(ids) for _, ids in docs_held], capacity, linear, quadratic)
            columns = [[] for _ in _NAMES]
            for k, start, n, sequence, offset in pieces:
                doc, ids = docs_held[k]
                for c, v in zip(columns, (doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + opened + sequence, offset), strict=True):
                    c.append(v)
            opened += max((p[3] for p in pieces), default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

        for batch in batches:
            for doc, body in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*encode(body or ""), end_id], dtype="<u4")
                docs_held.append((doc, ids))
                total += len(ids)
                if total >= shard_tokens:
                    yield flush()
                    docs_held.clear()
                    total = 0
        if docs_held:
            yield flush()

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
