"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers, shifted to be unsigned and stored by dimension as slices: slice j of a dimension is a bitmap over
the rows of a block with the rows' bit j. A query's score for all rows of a block is summed from slices by bitmap
arithmetic: the digits of the query's components are taken from high to low, the sum so far is doubled, and the slices of the dimensions that have the digit are added in
(complemented for negative components), through carry-save adders. The k best rows are then selected from the most significant slice downward;
of the rows that tie at the border, those with the smallest identifiers are taken by looking at each.

The index is made once: a row for each block of vectors, with its slices. A block holds as many vectors as ``block_bytes`` of components allow, whatever
their dimension. Queries come in blocks too; each pair of blocks is one unit of work, which gives at most k rows a query.

Vectors with components past 31 bits stand in blocks of their own kind, which have as many slices as their components have bits, however many; all sums are exact.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a finite component is quantised whatever its size; ranks are those of the exact scores, and ``score`` is null in a row
whose score passes 64 bits, there alone; vectors of different length never meet; null identifiers take no part. Every row is a candidate but the query's own: equal rows are kept once with their number, and
fill as many ranks; each of several equal queries has its own answers. An empty table gives an empty result; a query with fewer than k candidates gets all.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.storage import stage


#: Units of work have tasks of their own up to this number of tasks.
MOST_TASKS = 20_000


#: Bits of components that go through numpy's integers.
PLAIN_BITS = 31


def quantised(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, dim, wide, x array<double>, copies) of the distinct vectors that take part; ``wide`` is 0, or how many words of 32 bits the largest component takes beyond ``PLAIN_BITS``."""
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    own = vectors.filter(F.col(id).isNotNull()).filter(ok).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    largest = F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0))
    bits = F.log2(largest) + F.log2(F.lit(scale))
    wide = F.when(largest == 0.0, 0).otherwise(F.greatest(F.lit(0), F.ceil((bits + 0.01 - PLAIN_BITS) / 32).cast("int")))
    return own.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")).select("id", F.size("x").alias("dim"), wide.cast("int").alias("wide"), "x", "copies")


def whole(x: float, scale: float) -> int:
    """floor(scale * x), without an overflow; ``scale`` is a whole number."""
    return int(x) * int(scale) if abs(x) >= 2.0**53 else math.floor(x * scale)


def _add(total: list, numbers: list[list], width: int) -> list:
    """Bit-sliced sum: ``total`` plus all ``numbers`` (lists of bitmaps, low slice first), by columns of carry-save adders."""
    columns: list[list] = [[] for _ in range(width + 1)]
    for number in (total, *numbers):
        for j, s in enumerate(number):
            if s is not None:
                columns[j].append(s)
    out = []
    for j in range(width):
        column = columns[j]
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            ab = a ^ b
            column.insert(0, ab ^ c)
            columns[j + 1].append((a & b) | (ab & c))
        if len(column) == 2:
            a, b = column
            out.append(a ^ b)
            columns[j + 1].append(a & b)
        else:
            out.append(column[0] if column else None)
    return out


class SlicedBlock:
    """Slices of the distinct vectors of one dimension in a block, by identifier."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, slices: list[list[np.ndarray]], low: int, bits: int) -> None:
        self.ids, self.copies, self.rows, self.low, self.bits = ids, copies, len(ids), low, bits
        self.slices = slices
        self.dim = len(slices)
        words = -(-self.rows // 64)
        self.inverted = [[~s for s in own] for own in self.slices]
        self.all = np.packbits(np.arange(words * 64) < self.rows, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, q: np.ndarray) -> SlicedBlock:
        """q: rows x dimensions of integers of 64 bits, or of Python's as objects."""
        order = np.argsort(ids, kind="stable")
        ids, copies, q = ids[order], copies[order], q[order]
        rows, dim = q.shape
        low = int(q.min()) if q.size else 0
        bits = (int(q.max()) - low).bit_length() if q.size else 0
        size = 8 * -(-rows // 64)

        def column(d: int) -> list[np.ndarray]:
            n = -(-bits // 8)
            flat = b"".join((v - low).to_bytes(n, "little") for v in q[:, d].tolist())
            held = np.unpackbits(np.frombuffer(flat, np.uint8).reshape(rows, n), axis=1, bitorder="little") if n else np.empty((rows, 0), np.uint8)
            return [np.frombuffer(np.packbits(held[:, j], bitorder="little").tobytes().ljust(size, b"\0"), np.uint64) for j in range(bits)]

        return cls(ids, copies, [column(d) for d in range(dim)], low, bits)

    def packed(self) -> tuple[bytes, bytes, str, int, bytes]:
        return self.ids.tobytes(), self.copies.tobytes(), str(self.low), self.bits, b"".join(s.tobytes() for own in self.slices for s in own)

    @classmethod
    def unpacked(cls, ids: bytes, copies: bytes, low: str, bits: int, slices: bytes, dim: int) -> SlicedBlock:
        own = np.frombuffer(ids, np.int64)
        flat = np.frombuffer(slices, np.uint64).reshape(dim, bits, -(-len(own) // 64))
        return cls(own, np.frombuffer(copies, np.int64), [list(x) for x in flat], int(low), bits)

    def row(self, r: int) -> list[int]:
        return [self.low + sum((int(s[r // 64]) >> (r % 64) & 1) << j for j, s in enumerate(own)) for own in self.slices]

    def sums(self, query: list[int]) -> tuple[list, int]:
        """Slices of the shifted scores, and what to add to them for the score itself."""
        size = sum(abs(v) for v in query)
        width = max(1, (size * ((1 << self.bits) - 1)).bit_length()) if self.bits else 1
        total: list = [None] * width
        top = max((abs(v) for v in query), default=0).bit_length()
        for digit in reversed(range(top)):
            total = [None, *total[:-1]]
            total = _add(total, [self.slices[d] if v > 0 else self.inverted[d] for d, v in enumerate(query) if abs(v) >> digit & 1], width)
        negative = sum(-v for v in query if v < 0)
        # a negative component v times x is |v| * (2**bits - 1 - x) less |v| * (2**bits - 1)
        return total, sum(query) * self.low - negative * ((1 << self.bits) - 1)

    def best(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int, int]]:
        """(score, id, copies) of the k best distinct rows, without one copy of the query's own."""
        total, shift = self.sums(query)
        alive, copies = self.all.copy(), {}
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1]).tolist()
        own = next((r for r in range(a, b) if self.row(r) == query), None)
        if own is not None:
            copies[own] = int(self.copies[own]) - 1
            if not copies[own]:
                alive[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure = np.zeros_like(alive)
        for s in reversed(total):
            if s is None:
                continue
            hit = alive & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(hit).sum())
            if n > k:
                alive = hit
            else:
                sure |= hit
                alive = alive & ~s
                if n == k:
                    alive = np.zeros_like(alive)
                    break
        rows = self._rows(sure)
        rows = np.concatenate((rows, self._rows(alive)[: k - len(rows)]))  # rows stand in order of their identifiers
        out = []
        for r in rows.tolist():
            score = sum((int(s[r // 64]) >> (r % 64) & 1) << j for j, s in enumerate(total) if s is not None)
            out.append((score + shift, int(self.ids[r]), copies.get(r, int(self.copies[r]))))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


INDEX = "dim int, wide int, block int, ids binary, copies binary, low string, bits int, slices binary"


def _integers(x: list[float], scale: float) -> list[int]:
    return [whole(v, scale) for v in x]


def index_of(ready: DataFrame, sizes: DataFrame, block_bytes: int, scale: float) -> DataFrame:
    """ready(id, dim, wide, x, copies) -> one row for each block of vectors: its identifiers in order, and its slices."""

    def run(key, table):
        dim, wide, block = (k.as_py() for k in key)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["x"].chunks])
        q = np.floor(flat * scale).astype(np.int64) if not wide else np.array(_integers(flat.tolist(), scale), object)
        held = SlicedBlock.of(table["id"].to_numpy().astype(np.int64), table["copies"].to_numpy().astype(np.int64), q.reshape(table.num_rows, dim))
        ids, copies, low, bits, slices = held.packed()
        values = [dim, wide, block, ids, copies, low, bits, slices]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary()]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    # blocks of nearly equal size, by hash of the identifier: rows that share one stay together unless their vectors differ in kind
    return ready.join(sizes, ["dim", "wide"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks(block_bytes)).cast("int")).select("dim", "wide", "block", "id", "x", "copies").groupBy("dim", "wide", "block").applyInArrow(run, INDEX)


def blocks(block_bytes: int):
    """Number of blocks for ``n`` vectors of ``dim`` components of 8 bytes, or more for wide ones."""
    return F.ceil(F.col("n") * F.greatest(F.col("dim"), F.lit(1)) * (8 + 4 * F.col("wide")) / block_bytes).cast("int")


def order_key(score: int) -> bytes:
    """Bytes that sort as the numbers do, whatever their size."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - c for c in body)


def top_k(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, block_bytes: int = 32 << 20, query_rows: int = 2048, scale: float = 256.0) -> DataFrame:
    """For each row whose identifier is divisible by ``every``: query_id, rank, vec_id, score of its k best others."""
    ready = stage(quantised(vectors, id=id, vector=vector, scale=scale), "quantised")
    sizes = ready.groupBy("dim", "wide").agg(F.count(F.lit(1)).alias("n"))
    index = stage(index_of(ready, sizes, block_bytes, scale), "sliced")
    asked = ready.filter(F.col("id") % every == 0)
    parts = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts"))
    groups = asked.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), "parts").cast("int")).groupBy("dim", "part").agg(F.collect_list(F.struct("id", "x", "copies")).alias("queries"))
    heads = index.select("dim", "wide", "block")
    work = groups.join(heads, "dim")  # each part of the queries goes past every block of its dimension

    def run(key, table):
        queries = table["queries"][0].as_py()
        block = SlicedBlock.unpacked(*(table[c][0].as_py() for c in ("ids", "copies", "low", "bits", "slices")), key[0].as_py())
        out = []
        for query in queries:
            for score, v, copies in block.best(query["id"], _integers(query["x"], scale), k):
                out.append((query["id"], vector_name(query["x"]), query["copies"], v, order_key(score), score if -(1 << 63) <= score < 1 << 63 else None, min(copies, k)))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=["query_id", "vector", "asked", "vec_id", "place", "score", "copies"])

    # each pair of blocks is one group of bounded size: the stated query set goes past every block of the index
    units = heads.join(parts, "dim").select(F.sum("parts")).first()[0] or 0
    found = work.join(index, ["dim", "wide", "block"]).repartition(max(1, min(units, MOST_TASKS)), "dim", "wide", "block", "part").groupBy("dim", "wide", "block", "part").applyInArrow(run, "query_id long, vector binary, asked long, vec_id long, place binary, score long, copies long")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    # queries of one identifier are told apart by their vectors
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("place"), "vec_id"))
    best = each.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vector_name(x: list[float]) -> bytes:
    """Tells the vectors of one identifier apart."""
    return hashlib.sha256(np.array(x, np.float64).tobytes()).digest()
