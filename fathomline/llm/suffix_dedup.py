"""Substring dedup by distributed prefix doubling.

Each byte covered by a 50-byte string that also starts in a document with a smaller identifier goes; strings are judged on the
input. Spark deals all positions by the smallest gram hash of their window (see :mod:`windows`), so that the positions that can be equal are
sorted together. A segment that occurs whole in an earlier document is settled there. Of the rest, the positions are ranked by their first 8 bytes, then
sorted by pairs of ranks at offsets 8, 16 and 18, which gives ranks of 16, 32 and 50 bytes; after each round positions with a rank of their own are
left out. What still shares a rank after 50 bytes is a repeated string, and goes where the smallest document of its rank is smaller than its own.

Defined cases: null text counts as empty; rows that share an identifier leave each other alone, since neither's is smaller; null identifiers come after
all others and count as one another's equals; matches never cross documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm import windows as w
from fathomline.llm.storage import stage

WINDOW, GRAM = 50, 16
FINER = 8
_TABLE = w.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Bytes:
    def of(self, text: str | None) -> np.ndarray:
        return _TABLE[np.frombuffer((text or "").encode(), np.uint8)]


def refine(rank: np.ndarray, active: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of twice the reach for the ``active`` positions, and those that still share theirs.

    Pairs (rank, rank at offset) are sorted; a new rank is the old one plus the place within the old group, so that order is kept."""
    pair = rank[active + offset]
    order = np.lexsort((pair, rank[active]))
    where, pair = active[order], pair[order]
    old = rank[where]
    index = np.arange(len(where))
    head = np.ones(len(where), bool)
    head[1:] = old[1:] != old[:-1]
    part = head.copy()
    part[1:] |= pair[1:] != pair[:-1]
    group = np.maximum.accumulate(np.where(head, index, 0))
    own = np.maximum.accumulate(np.where(part, index, 0))
    rank[where] = old + own - group
    sizes = np.diff(np.concatenate((np.flatnonzero(part), [len(where)])))
    return rank, where[np.repeat(sizes, sizes) > 1]


def first_ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the first 8 bytes (positions near the end read zeros), and the positions that share theirs."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    value = np.zeros(len(data), np.uint64)
    for i in range(8):
        value = (value << np.uint64(8)) | padded[i : i + len(data)]
    order = np.argsort(value, kind="stable")
    sorted_value = value[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_value[1:] != sorted_value[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    sizes = np.diff(np.concatenate((np.flatnonzero(head), [len(order)])))
    return rank, order[np.repeat(sizes, sizes) > 1]


def repeated_earlier(data: np.ndarray, doc_of: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each position of ``data``: does its 50-byte string start at an allowed position of a smaller document too?"""
    rank, shared = first_ranks(np.concatenate((data, np.zeros(WINDOW, np.uint8))))
    common = np.zeros(len(rank), bool)
    common[shared] = True
    active = np.flatnonzero(allowed & common[: len(data)])
    hit = np.zeros(len(data), bool)
    # 50 bytes are read as 32 at p and p+18, those as 16 at p, p+16, p+18 and p+34: positions up to ``reach`` after p need the round's rank too
    for offset, reach in ((8, 34), (16, 18), (18, 0)):
        if not len(active):
            return hit
        steps = np.bincount(active, minlength=len(rank) + 1) - np.bincount(np.minimum(active + reach + 1, len(rank)), minlength=len(rank) + 1)
        todo = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & common)
        todo = todo[todo + offset < len(rank)]
        rank, shared = refine(rank, todo, offset)
        common[todo] = False
        common[shared] = True
        active = active[common[active]]
    if not len(active):
        return hit
    order = np.argsort(rank[active], kind="stable")
    where = active[order]
    head = np.ones(len(where), bool)
    head[1:] = rank[where][1:] != rank[where][:-1]
    least = np.minimum.reduceat(doc_of[where], np.flatnonzero(head))
    sizes = np.diff(np.concatenate((np.flatnonzero(head), [len(where)])))
    hit[where] = doc_of[where] > np.repeat(least, sizes)
    return hit


def settled(found: dict[str, np.ndarray]) -> np.ndarray:
    """Segments that occur whole in an earlier document of the same block: all their bytes go, whatever else there is."""
    order, heads = w.local_classes(found["key"], found["ctx"])
    docs = w.ranks(found)[order]
    least = np.minimum.reduceat(docs, heads) if len(heads) else docs
    out = np.zeros(len(order), bool)
    out[order] = docs > np.repeat(least, np.diff(np.concatenate((heads, [len(order)]))))
    return out


def _settle(buckets: int):
    """One bucket of segments -> ranges that go at once (part 0), and segments whose content must be looked at (part 1), by document bucket."""

    def run(key, table):
        ready = w.renumbered(w.by_part(table, 1), 0)
        found = w.gathered(w.by_part(table, 0))
        order = np.lexsort((found["start"], w.ranks(found), found["ctx"], found["key"]))
        found = {n: a[order] for n, a in found.items() if len(a) == len(order)}
        place = w.ranks(found)
        n = len(order)
        head = np.ones(n, bool)
        head[1:] = found["key"][1:] != found["key"][:-1]
        part = head.copy()
        part[1:] |= found["ctx"][1:] != found["ctx"][:-1]
        group, own = np.cumsum(head) - 1, np.maximum.accumulate(np.where(part, np.arange(n), 0))
        classes = np.bincount(group, part)[group]
        gone = place > place[own]
        look = ~gone & (classes > 1)
        out = []
        for number, mask in ((0, gone), (1, look)):
            if mask.any():
                chosen = {c: found[c][mask] for c in (("doc", "start", "wins") if number == 0 else ("key", "doc", "rank", "start", "wins")) if c in found}
                out.append(w.blobs(chosen, w.document_bucket(chosen["doc"], buckets), number))
        return pa.concat_tables([ready, pa.Table.from_batches(out, schema=w._BLOB_ARROW)])

    return run


def _contents(buckets: int):
    """Documents and the segments to look at -> the segments with their bytes, by bucket of their key."""

    def run(key, docs, asked):
        if not asked.num_rows or not docs.num_rows:
            return w._BLOB_ARROW.empty_table()
        found = w.gathered(asked)
        place = {r: i for i, r in enumerate(docs["row"].to_pylist())}
        texts, data = docs["text"], {}
        bodies = []
        for doc, start, wins in zip(found["doc"].tolist(), found["start"].tolist(), found["wins"].tolist(), strict=True):
            if doc not in data:
                data[doc] = (texts[place[doc]].as_py() or "").encode()
            bodies.append(data[doc][start : start + wins + WINDOW - 1])
        found = {c: a for c, a in found.items() if c != "ctx" and len(a) == len(bodies)}
        return pa.Table.from_batches([w.blobs(found, (found["key"] % np.uint64(buckets)).astype(np.int32), 0, bodies)])

    return run


def _double(buckets: int):
    """One bucket of segments with bytes -> ranges that go, by document bucket."""

    def run(key, table):
        found = w.gathered(table)
        data = np.frombuffer(b"".join(table["body"].to_pylist()), np.uint8)
        wins = found["wins"].astype(np.int64)
        sizes = wins + WINDOW - 1
        ends = np.cumsum(sizes)
        base = ends - sizes
        doc_of = np.repeat(w.ranks(found), sizes)
        allowed = np.arange(len(data)) < np.repeat(base + wins, sizes)
        hit = repeated_earlier(data, doc_of, allowed)
        # runs break at segment ends, since the last positions of a segment are never hit
        first, length = w.runs_of(hit)
        owner = np.searchsorted(ends, first, side="right")
        out = {"doc": found["doc"][owner], "start": (found["start"][owner] + (first - base[owner])).astype(np.uint32), "wins": length.astype(np.uint32)}
        return pa.Table.from_batches([w.blobs(out, w.document_bucket(out["doc"], buckets))] if len(first) else [], schema=w._BLOB_ARROW)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(want_text: bool):
    def run(key, docs, ranges):
        found = w.by_document(ranges) if ranges.num_rows else {}
        columns = [[] for _ in range(6)]
        for row, doc, text in zip(docs["row"].to_pylist(), docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            data, removed, spans = (text or "").encode(), 0, 0
            size = len(data)
            if row in found:
                start, wins = found[row]
                hit = w.marks(size, start, start.astype(np.int64) + wins + WINDOW - 1)
                removed, spans = int(hit.sum()), len(w.runs_of(hit)[0])
                data = np.frombuffer(data, np.uint8)[~hit].tobytes()
            for c, v in zip(columns, (doc, size, removed, spans, hashlib.sha256(data).hexdigest(), data.decode(errors="replace") if want_text else None), strict=True):
                c.append(v)
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def remove_repeated(docs: DataFrame, *, text: str = "text", id: str = "doc_id", want_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept text (bytes that no longer form a character are replaced)."""
    buckets = w.spread(docs, text)
    keyed = w.keyed_documents(docs, text=text, id=id)
    first = stage(w.dealt(w.segment_blobs(keyed, Bytes(), WINDOW, GRAM, buckets, settled), buckets).applyInArrow(_settle(buckets), w.BLOB), "suffix-settled")
    asked = first.filter("part = 1")
    # ranking holds a dozen numbers a position, so that the positions are dealt more finely than the segments were
    bodies = w.with_documents(keyed, asked, buckets, _contents(FINER * buckets), w.BLOB)
    second = stage(w.dealt(bodies, FINER * buckets).applyInArrow(_double(buckets), w.BLOB), "suffix-doubled")
    ranges = first.filter("part = 0").unionByName(second)
    out = w.with_documents(keyed, ranges, buckets, _cut(want_text), RESULT)
    return out if want_text else out.drop("kept")
