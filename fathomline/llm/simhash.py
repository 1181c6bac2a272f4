"""SimHash near-dedup by pigeonhole blocks.

Rows are reduced to distinct fingerprints first. A fingerprint is cut into 6 blocks; two that differ in at most 3 bits
agree in at least 3 whole blocks, so joining on each of the 20 choices of 3 blocks meets every close pair on a key of about
32 bits. Each bucket is read in key order as a stream, verified by Hamming distance and answered by a forest of links that
has its connected parts, never by all its pairs. A bucket with over ``bucket_rows`` fingerprints is cut again on the bits it
doesn't share yet: 4 sub-blocks, of which close pairs agree in at least one. That repeats until every bucket is small or its
free bits are spent, so nothing is capped.

The same join draws the first candidates for near copies by exact Jaccard similarity (:func:`similar_documents`); a prefix filter beside it
draws all that fingerprints may miss, and each link is verified on the sets of shingles.

Defined cases: null or wordless text has fingerprint zero, linked like any other; null identifiers take part but don't
name a component unless all are null; an empty table gives an empty result. ``keep_one_of_each`` judges rows, not identifiers: of a group the row with the smallest
identifier stays (null last; of those that share it, the one with the smallest text hash), and a text without a near copy stays whatever its identifier.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.components import connected_components
from fathomline.llm.storage import batches_of, discard, stage
from fathomline.operators.cluster import blocks, compared

BITS, DISTANCE, SEED = 64, 3, 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of lower-cased word shingles, repeats included; a text of fewer words is one shingle, a wordless one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def voted(h: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats included."""
    return voted(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, *, text: str, id: str, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out)], names=["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache(maxsize=100_000)
def _cut(mask: int, parts: int) -> tuple[int, ...]:
    """The bits set in ``mask``, cut into ``parts`` masks of nearly equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return tuple(sum(1 << b for b in piece.tolist()) for piece in np.array_split(np.array(bits, dtype=object), parts) if len(piece))


EVERY = (1 << BITS) - 1
#: Masks of a key with so few bits left have small buckets by themselves.
WHOLE = 8


def _first_masks() -> list[int]:
    """Each choice of 3 of the 6 blocks."""
    return [a | b | c for a, b, c in combinations(_cut(EVERY, 6), 3)]


def _finer_masks(mask: int) -> list[int]:
    """The mask with each quarter of its free bits added."""
    return [mask | piece for piece in _cut(~mask & EVERY, 4)]


def _keyed(batches):
    """(mask, fp), the mask null at first -> (mask, key, fp) for each finer mask; the key is what the mask leaves of the fingerprint."""
    for batch in batches:
        fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        old = [None if m is None else m % (1 << BITS) for m in batch["mask"].to_pylist()]
        for mask in set(old):
            own = fp[np.array([m == mask for m in old])]
            for finer in _first_masks() if mask is None else _finer_masks(mask):
                m = np.uint64(finer)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m).view(np.int64)), pa.array((own & m).view(np.int64)), pa.array(own.view(np.int64))], names=["mask", "key", "fp"])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (indices) that span the connected parts of the graph of pairs at most DISTANCE bits apart."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[front.pop()]) <= DISTANCE
            if near.any():
                new, rest = rest[near], rest[~near]
                links += [(root, x) for x in new]
                front += new.tolist()
    return links


LINKS = "u long, v long, mask long"


def _verify(bucket_rows: int):
    """Rows in order of (mask, key) -> links (mask null), and (v null) members of buckets that are too large."""

    def run(batches):
        held: list[np.ndarray] = []
        held_n, group, flooded = 0, None, False
        u: list = []
        v: list = []
        t: list = []

        def settle(fps):
            if len(fps) == 2:
                if int(fps[0] ^ fps[1]).bit_count() <= DISTANCE:
                    u.append(fps[0])
                    v.append(fps[1])
                    t.append(None)
            elif len(fps) > 2:
                for a, b in forest(fps):
                    u.append(fps[a])
                    v.append(fps[b])
                    t.append(None)

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(np.array(u, np.uint64).view(np.int64)), pa.array([None if x is None else int(np.uint64(x).view(np.int64)) for x in v], pa.int64()), pa.array(t, pa.int64())], names=["u", "v", "mask"])
            u.clear(), v.clear(), t.clear()
            return batch

        for batch in batches:
            mask, key, fp = (batch[n].to_numpy(zero_copy_only=False) for n in ("mask", "key", "fp"))
            fp = fp.view(np.uint64)
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = np.concatenate(([0], change, [len(fp)]))
            # groups of one row inside the batch have no pair
            sizes = np.diff(cuts)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                a, b = cuts[g], cuts[g + 1]
                own = (int(mask[a]), int(key[a]))
                if own != group:
                    if held_n > 1 and not flooded:
                        settle(np.concatenate(held))
                    held, held_n, group, flooded = [], 0, own, False
                held.append(fp[a:b])
                held_n += b - a
                if flooded or held_n > bucket_rows and BITS - (own[0] % (1 << BITS)).bit_count() > WHOLE:
                    flooded = True
                    for x in np.concatenate(held):
                        u.append(x)
                        v.append(None)
                        t.append(own[0])
                    held = []
            if len(u) > 50_000:
                yield out()
        if held_n > 1 and not flooded:
            settle(np.concatenate(held))
        if u:
            yield out()

    return run


def close_links(fps: DataFrame, *, bucket_rows: int = 4096) -> DataFrame:
    """fps(fp long, distinct) -> links (u, v) with the connected parts of all pairs that differ in at most 3 bits."""
    todo, links = fps.select(F.lit(None).cast("long").alias("mask"), "fp"), None
    while True:
        dealt = todo.mapInArrow(_keyed, "mask long, key long, fp long").repartition("mask", "key").sortWithinPartitions("mask", "key")
        got = stage(dealt.mapInArrow(_verify(bucket_rows), LINKS), "simhash-links")
        part = got.filter("v is not null").select("u", "v")
        links = part if links is None else links.unionByName(part)
        todo = got.filter("v is null").select("mask", F.col("u").alias("fp")).distinct()
        if todo.isEmpty():
            return links.distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id", shingle: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """One row per input row: id, fp, component (smallest identifier that links reach, the row's own included)."""
    prints = stage(with_fingerprints(docs, text=text, id=id, shingle=shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    members = connected_components(close_links(classes.select("fp"), bucket_rows=bucket_rows))
    labelled = classes.join(members, classes["fp"] == members["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = labelled.groupBy("part").agg(F.min("least").alias("component"))
    lookup = stage(labelled.join(named, "part").select("fp", "component"), "simhash-classes")
    return prints.join(lookup, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by exact Jaccard similarity: a prefix filter draws the candidates, so that no close pair can be lost, and each link is verified on the sets.

SIGN_BITS = 1024
#: Documents whose shingles are counted to put frequent shingles last, the number of those kept, and the least count. The order decides speed only.
SAMPLE, MOST_FREQUENT, FREQUENT = 10_000, 100_000, 3
#: Shingle buckets up to this size give all their pairs at once.
SMALL_BUCKET = 32
#: Bits of the map that tells which rows are no candidates, and sets that are held while others are compared with them.
MAP_BITS, BLOCK = 1 << 23, 256
#: Against rounding in products of the threshold.
EPSILON = 1e-9


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of lower-cased word shingles, in order."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _node(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64))


def _sign(hashes: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of SIGN_BITS cells: two sets differ in at least as many shingles as their signs in bits."""
    return np.packbits(np.bincount(hashes & (SIGN_BITS - 1), minlength=SIGN_BITS) & 1 == 1).tobytes()


def _fine_sign(hashes: np.ndarray) -> bytes:
    """A sign of as many cells as there are shingles, for sets of more than SIGN_BITS: of such sets that one says little."""
    bits = 1 << (len(hashes) - 1).bit_length() if len(hashes) > SIGN_BITS else 0
    return np.packbits(np.bincount(hashes & (bits - 1), minlength=bits) & 1 == 1).tobytes() if bits else b""


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two fine signs differ; the halves of the longer one are laid on one another."""
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def prefix(hashes: np.ndarray, jaccard: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(jaccard * n) + 1 shingles, frequent ones last: two sets of this similarity share one in both prefixes."""
    n = len(hashes)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: n - int(np.ceil(jaccard * n - EPSILON)) + 1 if n else 0]


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """docs(id, text) -> the most frequent shingles of a sample, in order, and their counts."""
    every = -(-docs.count() // SAMPLE)
    sampled = docs.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, every))) == 0)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            h, n = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    top = sampled.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    h, n = np.array([r["h"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _buckets(batches, columns: list[str]):
    """Rows in order of their key, by batches that end with a bucket, as numpy arrays; a node that repeats in a bucket counts once."""
    held = None
    for batch in batches:
        now = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1) if c == "sign" else batch[c].to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        key, node = now[0], now[1]
        if not len(key):
            continue
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        now = [x[fresh] for x in now]
        cut = np.searchsorted(now[0], now[0][-1])  # the last bucket may go on
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None:
        yield held


def _possible(jaccard: float, n, pos, m, at) -> np.ndarray:
    """Whether sets of sizes n and m, whose first common shingle has these positions, can be as similar as asked."""
    return np.minimum(n - pos, m - at) >= np.ceil(jaccard / (1 + jaccard) * (n + m) - EPSILON)


CANDIDATES = "u long, v long, key long, pos int, n int"


def _candidates(jaccard: float):
    """Rows in order of (key, node) -> pairs (key null): all of a small bucket, those with the first node of a larger one; and (v null) the rows of larger ones."""

    def run(batches):
        for key, node, pos, n in _buckets(batches, ["key", "node", "pos", "n"]):
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            sizes = np.diff(edges)
            size_of = np.repeat(sizes, sizes)
            first = np.repeat(edges[:-1], sizes)
            left = np.arange(len(key)) - first
            large = size_of > SMALL_BUCKET
            i = np.flatnonzero(large & (left > 0))
            pairs = [(first[i], i)]
            for d in range(1, SMALL_BUCKET):
                i = np.flatnonzero(~large & (left + d < size_of))
                if not len(i):
                    break
                pairs.append((i, i + d))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            ok = _possible(jaccard, n[a], pos[a], n[b], pos[b])
            found = np.unique(np.stack((node[a[ok]], node[b[ok]]), axis=1), axis=0)
            none, more = len(found), int(large.sum())
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32())], names=["u", "v", "key", "pos", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(more, pa.int64()), pa.array(key[large]), pa.array(pos[large]), pa.array(n[large])], names=["u", "v", "key", "pos", "n"])

    return run


def _pairs_between(jaccard: float):
    """Rows of large buckets in order of (key, node) -> the pairs of different parts that sizes, positions and signs leave possible."""

    def run(batches):
        for key, node, pos, n, part, sign in _buckets(batches, ["key", "node", "pos", "n", "part", "sign"]):
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                names, counts = np.unique(part[a:b], return_counts=True)
                # pairs inside the largest part are linked already; each other member meets the later members and the largest part
                main = part[a:b] == names[np.argmax(counts)]
                u, v = [], []
                for i in np.flatnonzero(~main).tolist():
                    x = a + i
                    others = a + np.flatnonzero((part[a:b] != part[x]) & (main | (np.arange(b - a) > i)))
                    others = others[_possible(jaccard, n[x], pos[x], n[others], pos[others])]
                    others = others[np.bitwise_count(sign[others] ^ sign[x]).sum(axis=1, dtype=np.int64) <= (n[x] + n[others]) * (1 - jaccard) / (1 + jaccard) + EPSILON]
                    u.append(np.minimum(node[x], node[others]))
                    v.append(np.maximum(node[x], node[others]))
                    if i % 1000 == 999:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
                        u, v = [], []
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """pairs(u, v) of nodes, u < v -> those whose shingle sets are as similar as asked, staged. Only candidates' texts are read into sets again."""

    def signs(batches):
        for batch in batches:
            n, m = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "m"))
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("su", "sv"))
            most = (n + m) * (1 - jaccard) / (1 + jaccard) + EPSILON
            ok = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most
            large = np.flatnonzero(ok & (np.minimum(n, m) > SIGN_BITS))
            fine = (batch[c].take(pa.array(large)).to_pylist() for c in ("fu", "fv"))
            ok[large] = [_apart(x, y) <= z for x, y, z in zip(*fine, most[large].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok)) for c in ("u", "v")], names=["u", "v"])

    def sets(batches):
        for batch in batches:
            at = batch["at"].to_numpy()
            batch = batch.filter(pa.array((asked_bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            own = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array([_node(h) for h in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["id", "h", "node", "t"])

    def close(both, n, m):
        return np.where(both >= np.ceil(jaccard / (1 + jaccard) * (n + m) - EPSILON), 1.0, -1.0)

    of_u, of_v = classes.select(F.col("node").alias("u"), "n", F.col("sign").alias("su"), F.col("fine").alias("fu")), classes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sign").alias("sv"), F.col("fine").alias("fv"))
    left = stage(pairs.distinct().join(of_u, "u").join(of_v, "v").select("u", "v", "n", "m", "su", "sv", "fu", "fv").mapInArrow(signs, "u long, v long"), "near-pairs")
    asked = stage(left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct().join(classes.select("node", "least"), "node").select("least.id", "least.h"), "near-asked")
    # texts don't travel: a map of bounded size leaves few rows besides those asked for, and their sets are joined
    place = F.pmod(F.xxhash64("id", "h"), F.lit(MAP_BITS)).cast("int")
    words = asked.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63))).alias("bits")).toPandas()
    asked_bits = np.zeros(MAP_BITS >> 6, np.uint64)
    asked_bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    with batches_of(docs.sparkSession, 500):
        drawn = docs.select("id", "h", place.alias("at"), "text").mapInArrow(sets, "id long, h long, node long, t array<long>")
        own = stage(drawn.join(asked, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select(F.col("node").alias("id"), "t"), "near-sets")
        dealt = blocks(left.select(F.col("u").alias("a"), F.col("v").alias("b")), own, BLOCK)
        out = stage(dealt.mapInArrow(lambda batches: compared(batches, close), "a long, b long, jaccard double").select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
    discard(asked)
    discard(left, own)
    return out


def _print_pairs(own: DataFrame) -> DataFrame:
    """own(node, fp) -> candidate pairs of nodes from the pigeonhole join of their fingerprints: a node of each fingerprint stands for it."""
    of = own.groupBy("fp").agg(F.min("node").alias("head"))
    close = close_links(of.select("fp"))
    heads = close.join(of.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(of.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v").select("a", "b")
    same = own.join(of, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return heads.unionByName(same).filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_links(own: DataFrame, classes: DataFrame, docs: DataFrame, *, shingle: int, jaccard: float) -> DataFrame:
    """own(node, n, fp, prefix) -> links (u, v) with the connected parts of all pairs of nodes as similar as asked.

    Fingerprints that are close give the first candidates. A prefix filter gives all others: a bucket of few nodes all its pairs, a large one
    the pairs with its first node; what these links leave apart in a large bucket is then compared, so that one large group needs few pairs."""
    rows = own.select("node", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "node", "pos", "n")
    drawn = stage(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates(jaccard), CANDIDATES), "near-candidates")
    links = _verified(drawn.filter("v is not null").select("u", "v").unionByName(_print_pairs(classes.select("node", "fp"))), classes, docs, shingle, jaccard)
    large = drawn.filter("v is null").select("key", F.col("u").alias("node"), "pos", "n")
    if large.isEmpty():
        discard(drawn)
        return links
    members = connected_components(links).withColumnRenamed("node", "m")
    parts = stage(large.join(members, F.col("node") == F.col("m"), "left").select("key", "node", "pos", "n", F.coalesce("component", "node").alias("part")), "near-parts")
    discard(drawn)
    mixed = parts.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
    signed = parts.join(mixed, "key", "left_semi").join(classes.select("node", "sign"), "node").select("key", "node", "pos", "n", "part", "sign")
    more = signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pairs_between(jaccard), "u long, v long")
    found = _verified(more, classes, docs, shingle, jaccard)
    discard(parts)
    return links.unionByName(found)


#: Stands for a null identifier, after all others.
LAST = (1 << 63) - 1


def similar_documents(docs: DataFrame, *, text: str = "text", id: str = "doc_id", shingle: int = 5, jaccard: float = 0.8) -> DataFrame:
    """(id, h, keep_id, keep_h), one row per input row: rows linked by pairs whose sets of word shingles have at least this Jaccard similarity. No such pair is missed, no other is linked.

    A row is named by its identifier (the largest long for null) and a 64-bit hash of its text; a group by its smallest name."""
    docs = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    frequent, counts = _frequent(docs.select("id", "text"), shingle)

    def prefixes(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch["text"].to_pylist()]
            prints = np.array([voted(h) for h in hashes], dtype=np.uint64).view(np.int64)
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            own = [prefix(h, jaccard, frequent, counts) for h in sets]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(prints, pa.int64()), pa.array([_node(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array([_sign(h) for h in sets], pa.binary()), pa.array([_fine_sign(h) for h in sets], pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["id", "h", "fp", "node", "n", "sign", "fine", "prefix"])

    own = stage(docs.mapInArrow(prefixes, "id long, h long, fp long, node long, n int, sign binary, fine binary, prefix array<long>"), "near")
    classes = stage(own.groupBy("node").agg(F.min(F.struct("id", "h")).alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("fine").alias("fine")), "near-nodes")
    members = connected_components(similar_links(own, classes, docs, shingle=shingle, jaccard=jaccard))
    labelled = classes.select("node", "least").join(members.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    named = labelled.groupBy("part").agg(F.min("least").alias("keep"))
    lookup = stage(labelled.join(named, "part").select("node", "keep"), "near-classes")
    discard(classes)
    return own.select("id", "h", "node").join(lookup, "node").select("id", "h", F.col("keep.id").alias("keep_id"), F.col("keep.h").alias("keep_h"))


def keep_one_of_each(docs: DataFrame, *, text: str = "text", id: str = "doc_id", shingle: int = 5, jaccard: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns; of rows equal in identifier and text one stays."""
    found = stage(similar_documents(docs, text=text, id=id, shingle=shingle, jaccard=jaccard).groupBy("id", "h").agg(F.first("keep_id").alias("keep_id"), F.first("keep_h").alias("keep_h"), F.count(F.lit(1)).alias("rows")), "near-rows")
    goes = found.filter("id <> keep_id or h <> keep_h").select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*names).alias("__row"), F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("__own_id"), F.xxhash64(F.col(text)).alias("__own_h"))
    stay = named.join(goes, (F.col("__own_id") == F.col("__id")) & (F.col("__own_h") == F.col("__h")), "left_anti")
    if not found.filter("rows > 1").isEmpty():
        order = Window.partitionBy("__own_id", "__own_h").orderBy(F.to_json("__row"))
        stay = stay.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return stay.select("__row.*")
