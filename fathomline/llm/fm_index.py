"""Substring dedup of words by compressed FM-indexes.

A window of 35 words is repeated if its word sequence also starts anywhere else. Windows are dealt to shards by the smallest gram hash in
them (see :mod:`windows`); a shard's index is built over one copy of each distinct segment with a repeated key, weighted by its number of
copies. The index is the Burrows-Wheeler transform of the segments, sorted by their first 35 words, as a wavelet tree (in matrix layout) of packed bits with counts per
64 of them. Segments are then streamed through it, thousands side by side: backward search gives matching statistics from right to left, capped at 35 words,
and where they reach 35 with a weight of two or more the window is reported. What was found for a distinct segment holds for all its copies.

Words are compared by 64-bit hashes.

Defined cases: null text has no words; rows that share an identifier count as different documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from fathomline.llm import windows as w
from fathomline.llm.storage import stage

WINDOW, GRAM = 35, 10


class Words:
    def of(self, text: str | None) -> np.ndarray:
        hashed = xxhash.xxh64_intdigest
        return w.mixed(np.array([hashed(x) for x in (text or "").encode().split()], dtype=np.uint64))


class WaveletMatrix:
    """rank of any symbol up to any place of a sequence, from one packed bit vector a level."""

    def __init__(self, data: np.ndarray, alphabet: int) -> None:
        self.levels = max(1, int(alphabet - 1).bit_length())
        n = len(data)
        self.bits, self.counts, self.zeros = [], [], []
        current = data.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (current >> level & 1).astype(bool)
            packed = np.zeros(-(-(n + 1) // 64) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            packed = packed.view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int32)
            self.bits.append(packed)
            self.counts.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(ones, dtype=np.int32)))[:-1])
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate((current[~bit], current[bit]))
        # where each symbol's run starts after the last level
        self.first = np.zeros(alphabet, np.int64)
        heads = np.flatnonzero(np.concatenate(([True], current[1:] != current[:-1]))) if n else np.empty(0, np.int64)
        self.first[current[heads]] = heads

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place`` (elementwise)."""
        at = place
        for k in range(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` symbols, and where neighbours differ in their first ``depth - 1``."""
    n, rank, reach = len(text), text.astype(np.int64), 1

    def ranked(pair):
        order = np.argsort(pair)
        ordered = pair[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return out

    def paired(offset):
        return rank * (n + 2) + np.concatenate((rank[offset:] + 1, np.zeros(min(offset, n), np.int64)))[:n]

    while reach * 2 <= depth - 1:
        rank = ranked(paired(reach))
        reach *= 2
    shorter = paired(depth - 1 - reach) if depth - 1 > reach else rank
    order = np.argsort(paired(depth - reach), kind="stable")
    edge = np.ones(n + 1, bool)
    edge[1:n] = shorter[order][1:] != shorter[order][:-1]
    return order, edge


class FMIndex:
    """Weighted counts of symbol strings of up to ``depth`` symbols in a text of segments that end with symbol 0."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, alphabet: int, depth: int) -> None:
        n = self.n = len(text)
        order, edge = suffix_order(text, depth)
        self.tree = WaveletMatrix(text[order - 1], alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.before = np.cumsum(counts) - counts
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))
        # the nearest places, left and right, where suffixes differ in their first depth - 1 symbols
        place = np.arange(n + 1)
        self.left = np.maximum.accumulate(np.where(edge, place, 0)).astype(np.int32)
        self.right = np.minimum.accumulate(np.where(edge, place, n)[::-1])[::-1].astype(np.int32)

    def step(self, symbol, low, high):
        """The interval of symbol + string from the interval of string."""
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)

    def shorter(self, low, high):
        """From the interval of a string of ``depth`` symbols to that of its first depth - 1."""
        return self.left[low].astype(np.int64), self.right[high].astype(np.int64)


def repeated_windows(index: FMIndex, text: np.ndarray, base: np.ndarray, size: np.ndarray, window: int, least: int = 2, lanes: int = 1 << 15) -> np.ndarray:
    """For each place of ``text``: does the window that starts there, inside one of the segments, weigh ``least`` or more?

    All segments of a slice advance together, one backward step a turn. A lane holds the string [at, end), which weighs enough. It goes on to the
    left, giving up its last symbol first when the string is a whole window. When that fails at p, the longest string from p that weighs enough is found by trying
    lengths between the known good and bad ones, each from its own right end; the lane goes on from there."""
    hit = np.zeros(len(text), bool)
    for a in range(0, len(base), lanes):
        _search(index, text, base[a : a + lanes], size[a : a + lanes], window, least, hit)
    return hit


def _search(index, text, base, size, window, least, hit) -> None:
    n = index.n
    stop = base.astype(np.int64)
    at = stop + size
    end = at.copy()
    low, high = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    # while probing: p is the place to reach, good and bad the lengths known, kept the interval of the good one
    p = np.full(len(at), -1, np.int64)
    good, bad = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    kept_low, kept_high = low.copy(), high.copy()
    while len(at):
        full = (end - at == window) & (p < 0)
        if full.any():
            short_low, short_high = index.shorter(low[full], high[full])
            low[full], high[full] = short_low, short_high
            end[full] -= 1
        new_low, new_high = index.step(text[at - 1], low, high)
        ok = index.weight[new_high] - index.weight[new_low] >= least
        probing = p >= 0
        at = np.where(ok, at - 1, at)
        low, high = np.where(ok, new_low, low), np.where(ok, new_high, high)
        done = ok & ~probing & (end - at == window)
        hit[at[done]] = True
        # a probe that arrived, or broke off
        arrived, broke = ok & probing & (at == p), ~ok & probing
        good = np.where(arrived, end - p, good)
        kept_low, kept_high = np.where(arrived, low, kept_low), np.where(arrived, high, kept_high)
        bad = np.where(broke, end - p, bad)
        failed = ~ok & ~probing
        if failed.any():
            p = np.where(failed, at - 1, p)
            bad = np.where(failed, end - at + 1, bad)
            good = np.where(failed, 0, good)
        turn = arrived | broke | failed
        if turn.any():
            settled = turn & (bad - good <= 1)
            again = turn & ~settled
            length = np.minimum(bad - 1, np.where(good == 0, np.minimum(3, (bad + 1) // 2), good + np.maximum(1, np.minimum(good, (bad - good) // 2))))
            end = np.where(settled, p + good, np.where(again, p + length, end))
            at = np.where(settled, p, np.where(again, p + length, at))
            low = np.where(settled, np.where(good > 0, kept_low, 0), np.where(again, 0, low))
            high = np.where(settled, np.where(good > 0, kept_high, n), np.where(again, n, high))
            p = np.where(settled, -1, p)
        # a window can't start left of the segment; nor can one end after ``end``
        over = (p < 0) & ((at <= stop) | (end - stop < window))
        if over.any():
            keep = ~over
            stop, at, end, low, high, p, good, bad, kept_low, kept_high = (x[keep] for x in (stop, at, end, low, high, p, good, bad, kept_low, kept_high))


def settled(found: dict[str, np.ndarray]) -> np.ndarray:
    """All but two of the segments of a block that have the same words: the two stand for them in the index with a weight of two, the others are repeated whole."""
    order, heads = w.local_classes(found["key"], found["ctx"])
    nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(order)]))))
    out = np.zeros(len(order), bool)
    out[order] = nth >= 2
    return out


def _settle(buckets: int):
    """One bucket of segments -> those with a repeated key (part 0), one of each class to be read (part 1, by document bucket), and ranges known to be repeated (part 2)."""

    def run(key, table):
        ready = w.renumbered(w.by_part(table, 1), 2)
        found = w.gathered(w.by_part(table, 0))
        order = np.lexsort((found["start"], found["doc"], found["ctx"], found["key"]))
        found = {n: a[order] for n, a in found.items() if len(a) == len(order)}
        n = len(order)
        head = np.ones(n, bool)
        head[1:] = found["key"][1:] != found["key"][:-1]
        part = head.copy()
        part[1:] |= found["ctx"][1:] != found["ctx"][:-1]
        sizes = np.diff(np.concatenate((np.flatnonzero(head), [n])))
        common = np.repeat(sizes, sizes) > 1
        out = []
        if common.any():
            own = {c: found[c][common] for c in ("key", "ctx", "doc", "start", "wins")}
            out.append(w.blobs(own, np.full(common.sum(), key[0].as_py(), np.int32), 0))
            first = {c: found[c][common & part] for c in own}
            out.append(w.blobs(first, w.document_bucket(first["doc"], buckets), 1))
        return pa.concat_tables([ready, pa.Table.from_batches(out, schema=w._BLOB_ARROW)])

    return run


def _contents(buckets: int):
    """Documents and the segments to read -> the segments with their words, by bucket of their key."""
    words = Words()

    def run(key, docs, asked):
        if not asked.num_rows or not docs.num_rows:
            return w._BLOB_ARROW.empty_table()
        found = w.gathered(asked)
        place = {r: i for i, r in enumerate(docs["row"].to_pylist())}
        texts, data, bodies = docs["text"], {}, []
        for doc, start, wins in zip(found["doc"].tolist(), found["start"].tolist(), found["wins"].tolist(), strict=True):
            if doc not in data:
                data[doc] = words.of(texts[place[doc]].as_py())
            bodies.append(data[doc][start : start + wins + WINDOW - 1].tobytes())
        return pa.Table.from_batches([w.blobs(found, (found["key"] % np.uint64(buckets)).astype(np.int32), 0, bodies)])

    return run


def search_shard(found: dict[str, np.ndarray], words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, number of windows) of the repeated windows among distinct segments with their words and weights."""
    sizes = found["wins"].astype(np.int64) + WINDOW - 1
    names, symbols = np.unique(words, return_inverse=True)
    total = len(words) + len(sizes)
    text = np.zeros(total, np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(total, bool)
    inside[base + sizes] = False
    text[inside] = symbols + 1
    index = FMIndex(text, np.where(inside, np.repeat(weight, sizes + 1), 0), len(names) + 1, WINDOW)
    hit = repeated_windows(index, text, base, sizes, WINDOW)
    first, length = w.runs_of(hit)
    owner = np.searchsorted(base, first, side="right") - 1
    return owner, first - base[owner], length


def _report(buckets: int):
    """One shard: all segments with a repeated key, and the words of the distinct ones -> repeated ranges of all documents, by document bucket."""

    def run(key, copies, distinct):
        if not distinct.num_rows:
            return w._BLOB_ARROW.empty_table()
        all_, one = w.gathered(copies), w.gathered(distinct)
        words = np.frombuffer(b"".join(distinct["body"].to_pylist()), np.uint64)
        # copies by class: classes in order of (key, ctx) on both sides
        order = np.lexsort((all_["ctx"], all_["key"]))
        all_ = {n: a[order] for n, a in all_.items() if len(a) == len(order)}
        fresh = np.ones(len(order), bool)
        fresh[1:] = (all_["key"][1:] != all_["key"][:-1]) | (all_["ctx"][1:] != all_["ctx"][:-1])
        heads = np.flatnonzero(fresh)
        counts = np.diff(np.concatenate((heads, [len(order)])))
        rank = np.empty(len(heads), np.int64)
        rank[np.lexsort((one["ctx"], one["key"]))] = np.arange(len(heads))  # class of each distinct segment
        owner, first, length = search_shard(one, words, np.minimum(counts, 2)[rank])
        cls = rank[owner]
        # every found range once for each copy of its class
        times = counts[cls]
        copy = np.repeat(heads[cls], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = {"doc": all_["doc"][copy], "start": (all_["start"][copy] + np.repeat(first, times)).astype(np.uint32), "wins": np.repeat(length, times).astype(np.uint32)}
        return pa.Table.from_batches([w.blobs(out, w.document_bucket(out["doc"], buckets))] if len(copy) else [], schema=w._BLOB_ARROW)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(want_text: bool):
    def run(key, docs, ranges):
        found = w.by_document(ranges) if ranges.num_rows else {}
        columns = [[] for _ in range(5)]
        for row, doc, text in zip(docs["row"].to_pylist(), docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            own = (text or "").encode().split()
            size = len(own)
            if row in found:
                start, wins = found[row]
                hit = w.marks(size, start, start.astype(np.int64) + wins + WINDOW - 1)
                own = [x for x, gone in zip(own, hit.tolist(), strict=True) if not gone]
            kept = b" ".join(own)
            for c, v in zip(columns, (doc, size, size - len(own), hashlib.sha256(kept).hexdigest(), kept.decode() if want_text else None), strict=True):
                c.append(v)
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def remove_repeated(docs: DataFrame, *, text: str = "text", id: str = "doc_id", want_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept words joined by single spaces."""
    buckets = w.spread(docs, text)
    keyed = w.keyed_documents(docs, text=text, id=id)
    first = stage(w.dealt(w.segment_blobs(keyed, Words(), WINDOW, GRAM, buckets, settled), buckets).applyInArrow(_settle(buckets), w.BLOB), "fm-segments")
    distinct = w.with_documents(keyed, first.filter("part = 1"), buckets, _contents(buckets), w.BLOB)
    copies = first.filter("part = 0")
    second = stage(copies.groupBy("bucket").cogroup(distinct.groupBy("bucket")).applyInArrow(_report(buckets), w.BLOB), "fm-ranges")
    ranges = first.filter("part = 2").unionByName(second)
    out = w.with_documents(keyed, ranges, buckets, _cut(want_text), RESULT)
    return out if want_text else out.drop("kept")
