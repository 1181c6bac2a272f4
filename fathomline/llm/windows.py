"""Meeting place for equal windows: the common ground of the two substring dedups.

A window is L consecutive symbols of one document (words or bytes). Its key is the smallest hash of the k-symbol grams
inside it; equal windows have equal keys, wherever they stand. Neighbouring windows with one key, at one place, form a segment, so that a
document becomes a few segments whose windows are all its windows. Segments are dealt by key, and every window meets all windows equal to it
in one place; a key that occurs once in the corpus has no repeated window and goes no further.

Segments with equal key and equal content are one class, which is told apart by a 64-bit hash of the content beside the 64-bit key.
Contents travel only once for a class whose key is repeated, not for each copy.

Arrays travel as binary columns, one row for many segments, so that Spark moves few rows whatever the number of positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.storage import stage

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

BLOB = "bucket int, part int, key binary, ctx binary, doc binary, rank binary, start binary, wins binary, body binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), *((n, pa.binary()) for n in ("key", "ctx", "doc", "rank", "start", "wins", "body"))])
TYPES = {"key": np.uint64, "ctx": np.uint64, "doc": np.int64, "rank": np.int64, "start": np.uint32, "wins": np.uint32}
#: Most tasks a table of blobs is dealt to; beyond that a task works through several buckets, one after another.
MOST_TASKS = 50_000
LAST = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of concatenated documents.

    symbols: uint64, well mixed; bounds: offsets of the documents, the last being the end. Returns key, ctx, owner (number of the document),
    start (in the document) and wins (number of windows)."""
    n = len(symbols)
    lengths = np.diff(bounds)
    if n < window or lengths.max(initial=0) < window:
        return {k: np.empty(0, np.int64 if k == "owner" else TYPES[k]) for k in ("key", "ctx", "owner", "start", "wins")}
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * _powers(n, _BASE), dtype=np.uint64)))
    back = _powers(n, _INVERSE)
    grams = least = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    span, done = window - gram + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    valid = np.arange(len(least)) + window <= bounds[1:][owner]
    fresh = np.ones(len(least), bool)
    # also where the window leaves the first of several places of its smallest gram: equal windows of one document are then in different segments
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (grams[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(fresh & valid)
    # a run ends where the next one starts or where its document has no further window
    end = np.minimum(np.concatenate((np.flatnonzero(fresh)[1:], [len(least)]))[np.searchsorted(np.flatnonzero(fresh), first)], bounds[1:][owner[first]] - window + 1)
    wins = end - first
    last = first + wins - 1 + window
    ctx = mixed(mixed((sums[last] - sums[first]) * back[first]) + wins.astype(np.uint64))
    own = owner[first]
    return {"key": least[first], "ctx": ctx, "owner": own, "start": (first - bounds[:-1][own]).astype(np.uint32), "wins": wins.astype(np.uint32)}


def split_blocks(n: int, window: int) -> list[tuple[int, int]]:
    """Ranges of a document's symbols, of bounded size, that have each of its windows once."""
    if n <= 2 * BLOCK:
        return [(0, n)]
    return [(a, min(n, a + BLOCK + window - 1)) for a in range(0, n - window + 1, BLOCK)]


def blobs(arrays: dict[str, np.ndarray], bucket: np.ndarray, part: int = 0, bodies: list[bytes] | None = None) -> pa.RecordBatch:
    """One row for each bucket that occurs; arrays keep their order within it."""
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    cuts = [*cuts.tolist(), len(order)]
    columns: dict[str, list] = {n: [] for n in TYPES}
    body = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        for n in TYPES:
            columns[n].append(arrays[n][own].astype(TYPES[n]).tobytes() if n in arrays and len(arrays[n]) == len(bucket) else None)
        body.append(b"".join(bodies[i] for i in own.tolist()) if bodies is not None else None)
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([part] * len(names), pa.int32()), *(pa.array(columns[n], pa.binary()) for n in TYPES), pa.array(body, pa.binary())], schema=_BLOB_ARROW)


def gathered(table: pa.Table) -> dict[str, np.ndarray]:
    """The arrays of all rows of a table of blobs, one after another."""
    out = {}
    for n, kind in TYPES.items():
        out[n] = np.concatenate([np.frombuffer(x, kind) for x in table[n].to_pylist() if x is not None] or [np.empty(0, kind)])
    return out


def keyed_documents(docs: DataFrame, *, text: str, id: str) -> DataFrame:
    """(row, doc_id, text) with a unique row number; where identifiers aren't unique also ``rank``, which orders as they do.

    As long as identifiers are unique they are row number and rank. Otherwise the table is sorted and written once; rows that share an
    identifier share a rank, null identifiers have the last one."""
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    odd = own.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        return own.select(F.col("doc_id").alias("row"), "doc_id", "text")
    return stage(own.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "text"), "keyed")


def ranks(found: dict[str, np.ndarray]) -> np.ndarray:
    """What orders the documents of gathered segments."""
    return found["rank"] if len(found.get("rank", ())) == len(found["doc"]) else found["doc"]


def spread(docs: DataFrame, text: str, unit: int = 12 << 20) -> int:
    """Number of buckets that keeps each to about ``unit`` bytes of text, as measured by one scan."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // unit))


def local_classes(key: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal segments together (else it keeps their order), and the heads of the classes in it."""
    both = mixed(key ^ (ctx << np.uint64(1)))
    order = np.argsort(both, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = (both[order][1:] != both[order][:-1]) | (key[order][1:] != key[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
    return order, np.flatnonzero(head)


def segment_blobs(docs: DataFrame, symbols, window: int, gram: int, buckets: int, settled) -> DataFrame:
    """Segments of ``docs`` (row, text) as blobs by bucket of their key (part 0).

    ``settled(found)`` marks the segments that the others of their block of rows settle already: those go to the bucket of their
    document (part 1) and spare the key's bucket the copies, so that a key's load there is by blocks, not by documents."""

    ranked = "rank" in docs.columns

    def run(batches):
        held, ids, places, starts, total = [], [], [], [], 0

        def flush():
            bounds = np.concatenate(([0], np.cumsum([len(h) for h in held])))
            found = segments(np.concatenate(held), bounds, window, gram)
            own = found.pop("owner")
            found["doc"] = np.array(ids, np.int64)[own]
            if ranked:
                found["rank"] = np.array(places, np.int64)[own]
            found["start"] = found["start"] + np.array(starts, np.uint32)[own]
            done = settled(found)
            for part, chosen in ((0, ~done), (1, done)):
                if chosen.any():
                    own_ = {n: a[chosen] for n, a in found.items()}
                    if part:
                        own_ = {n: own_[n] for n in ("doc", "start", "wins")}
                    yield blobs(own_, document_bucket(own_["doc"], buckets) if part else (own_["key"] % np.uint64(buckets)).astype(np.int32), part)

        for batch in batches:
            for row, place, body in zip(batch["row"].to_pylist(), batch["rank" if ranked else "row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = symbols.of(body)
                for a, b in split_blocks(len(s), window):
                    if b - a < window:
                        continue
                    held.append(s[a:b])
                    ids.append(row)
                    places.append(place)
                    starts.append(a)
                    total += b - a
                    if total >= BLOCK:
                        yield from flush()
                        held, ids, places, starts, total = [], [], [], [], 0
        if held:
            yield from flush()

    return docs.select("row", "text", *(["rank"] if ranked else [])).mapInArrow(run, BLOB)


def by_part(table: pa.Table, part: int) -> pa.Table:
    return table.filter(pc.equal(table["part"], part))


def renumbered(table: pa.Table, part: int) -> pa.Table:
    return table.set_column(1, _BLOB_ARROW.field(1), pa.array([part] * table.num_rows, pa.int32())).cast(_BLOB_ARROW)


def dealt(table: DataFrame, buckets: int):
    """A table of blobs grouped by bucket, about one group a task as long as there aren't too many."""
    return table.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket")


def with_documents(docs: DataFrame, rows: DataFrame, buckets: int, function, schema: str) -> DataFrame:
    """cogroup of documents (row, doc_id, text) with blobs dealt by document bucket."""
    left = docs.select("row", "doc_id", "text").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    return left.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(function, schema)


def document_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(row), buckets) as Spark has it (XXH64 of one long, seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotl(x, r):
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    h = np.full(len(rows), 42, np.uint64) + p5 + np.uint64(8)
    h = h ^ (rotl(rows.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = rotl(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    return (h.view(np.int64) % buckets).astype(np.int32)


def marks(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in one of the ranges."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, start.astype(np.int64), 1)
    np.add.at(steps, end.astype(np.int64), -1)
    return np.cumsum(steps[:-1]) > 0


def by_document(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(start, wins) of each document in a table of blobs."""
    found = gathered(table)
    order = np.argsort(found["doc"], kind="stable")
    docs, cuts = np.unique(found["doc"][order], return_index=True)
    cuts = [*cuts.tolist(), len(order)]
    return {d: (found["start"][order[a:b]], found["wins"][order[a:b]]) for d, a, b in zip(docs.tolist(), cuts[:-1], cuts[1:], strict=True)}


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first
