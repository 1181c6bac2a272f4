"""Exact clustering by centroids of integers, screened in float32.

Each round assigns all vectors to their nearest centroid (squared Euclidean distance, ties to the smaller number) and moves every centroid that has vectors to the
componentwise floor of their mean. A task takes the products of a block of vectors with all centroids in float32 and puts an interval around each distance that
covers every rounding error: with n components, any order of summation errs by at most g(n + 3) times the product of the two norms, g(m) = m u / (1 - m u), u = 2**-24
(Higham, 2002). Centroids whose interval starts above the least upper end are out; a vector with more than one left has those distances worked out in integers.
All distances that are returned are exact.

Vectors and centroids are scaled by powers of two before they become float32, so that none is too large; where float64 can't hold a bound either, the interval is
unbounded and the integers decide. Components of up to 2**27 are worked with as 64-bit integers, larger ones as Python's.

A round returns to the driver the centroids alone, whose number is a parameter: sums are taken in tasks, cut into 32-bit limbs and added up by Spark, so that no sum overflows.

Defined cases: vectors that are null, of another dimension, or hold null or non-finite components take no part; a null identifier takes part but comes last where the first centroids are drawn; rows that
repeat are rows of their own (of rows with one identifier the smaller vector is drawn first); fewer vectors than centroids give as many centroids as vectors; an empty table gives an empty result;
``distance``, ``cluster_inertia`` and ``inertia`` are null where the number passes 64 bits, for that row or sum alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.storage import stage

#: Components up to this size have squared distances that fit 64 bits (up to 64 components) and go through numpy's integers.
SMALL = 1 << 27
LIMB = 32
_LONGEST = (1 << 63) - 1


def taking_part(vectors: DataFrame, *, dimensions: int, id: str, vector: str) -> DataFrame:
    """(id, x array<double>) of the vectors of ``dimensions`` finite components."""
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return vectors.filter((F.size(vector) == dimensions) & ok).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), without an overflow."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


class Block:
    """Quantised vectors: ``small`` as integers of 64 bits (rows with a larger component hold zeros there), ``large`` by row as Python's."""

    def __init__(self, x: np.ndarray, scale: int) -> None:
        self.q = np.floor(np.clip(x, -2.0 * SMALL, 2.0 * SMALL) * scale)
        big = np.flatnonzero((np.abs(self.q) > SMALL).any(axis=1))
        self.large = {int(r): [whole(v, scale) for v in x[r].tolist()] for r in big}
        self.q[big] = 0
        self.q = self.q.astype(np.int64)
        self.is_large = np.zeros(len(x), bool)
        self.is_large[big] = True

    def row(self, r: int) -> list[int]:
        return self.large[r] if r in self.large else self.q[r].tolist()


class Centroids:
    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        self.large = np.array([any(abs(v) > SMALL for v in c) for c in rows])
        self.q = np.array([[0] * len(c) if big else c for c, big in zip(rows, self.large, strict=True)], np.int64).reshape(len(rows), -1)
        scaled = [_scaled(c) for c in rows]
        self.single = np.array([s for s, _ in scaled], np.float32).reshape(len(rows), -1)
        self.power = np.array([p for _, p in scaled])
        with np.errstate(all="ignore"):
            self.norm = np.array([_norm(c) for c in rows])
            self.square = np.array([_double(sum(v * v for v in c)) for c in rows])

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()

    def nearest(self, block: Block) -> tuple[np.ndarray, list[int | None]]:
        """The nearest centroid of each row, and its exact squared distance (None past 64 bits)."""
        n, u = self.single.shape[1], 2.0**-24
        rows = block.q.astype(np.float32)
        power = np.zeros(len(rows))
        norm = np.sqrt((block.q.astype(np.float64) ** 2).sum(axis=1))
        for r, values in block.large.items():
            scaled, power[r] = _scaled(values)
            rows[r], norm[r] = scaled, _norm(values)
        with np.errstate(all="ignore"):
            product = np.ldexp((rows @ self.single.T).astype(np.float64), (power[:, None] + self.power).astype(np.int64))
            sizes = norm[:, None] * self.norm
            error = 2 * (n + 3) * u / (1 - (n + 3) * u) * sizes * (1 + 1e-9) + 2.0**-48 * (self.square + 2 * sizes)
            middle = self.square - 2 * product  # without the vector's own square, which all centroids share
            low, high = middle - error, middle + error
            unsure = ~np.isfinite(low) | ~np.isfinite(high)
            low[unsure], high[unsure] = -np.inf, np.inf
        left = low <= high.min(axis=1)[:, None]
        best = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        plain = open_rows[~block.is_large[open_rows] & ~(left[open_rows] & self.large).any(axis=1)]
        if len(plain):
            best[plain] = self._exact(block, plain, left[plain])
        for r in np.setdiff1d(open_rows, plain).tolist():
            values = block.row(r)
            best[r] = min((self._distance(values, k), k) for k in np.flatnonzero(left[r]).tolist())[1]
        easy = ~block.is_large & ~self.large[best]
        distance = np.zeros(len(rows), np.int64)
        distance[easy] = ((block.q[easy] - self.q[best[easy]]) ** 2).sum(axis=1)
        out: list[int | None] = distance.tolist()
        for r in np.flatnonzero(~easy).tolist():
            d = self._distance(block.row(r), int(best[r]))
            out[r] = d if d <= _LONGEST else None
        return best, out

    def _exact(self, block: Block, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of the shortlisted centroids of some rows the nearest, the smallest number first."""
        row, k = np.nonzero(left)
        distance = ((block.q[at[row]] - self.q[k]) ** 2).sum(axis=1)
        order = np.lexsort((k, distance, row))
        first = np.concatenate(([True], row[order][1:] != row[order][:-1]))
        return k[order][first]

    def _distance(self, values: list[int], k: int) -> int:
        return sum((a - b) ** 2 for a, b in zip(values, self.rows[k], strict=True))


def _double(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.inf


def _norm(values: list[int]) -> float:
    return math.sqrt(s) * (1 + 1e-12) if (s := _double(sum(v * v for v in values))) < math.inf else math.inf


def _scaled(values: list[int]) -> tuple[list[float], int]:
    """The values over a power of two that brings the largest to ``SMALL`` or so, and that power; small values stay as they are."""
    power = max(0, max((abs(v) for v in values), default=0).bit_length() - SMALL.bit_length())
    return [v / (1 << power) for v in values], power


def _blocks(batches, scale: int, dimensions: int, rows: int = 1 << 14):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            # flatten() heeds the slice
            yield part["id"], Block(part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)


def sums(ready: DataFrame, centroids: Centroids, *, scale: int, dimensions: int) -> DataFrame:
    """(cluster, dim, limb, n, part): the limbs of the sums of each cluster's vectors. ``n`` counts vectors, in dim 0 and limb 0."""

    def run(batches):
        count = np.zeros(len(centroids.rows), np.int64)
        total: dict[int, list[int]] = {}
        for _, block in _blocks(batches, scale, dimensions):
            best, _ = centroids.nearest(block)
            count += np.bincount(best, minlength=len(count))
            for k in np.unique(best).tolist():
                own = block.q[best == k].sum(axis=0).tolist()  # at most 2**14 rows of 2**27
                total[k] = [a + b for a, b in zip(total[k], own, strict=True)] if k in total else own
            for r, values in block.large.items():
                total[int(best[r])] = [a + b for a, b in zip(total[int(best[r])], values, strict=True)]
        rows = [(k, 0, 0, int(count[k]), 0) for k in total]
        for k, values in total.items():
            for d, v in enumerate(values):
                sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    rows.append((k, d, limb, 0, sign * (v & ((1 << LIMB) - 1))))
                    v, limb = v >> LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[j], pa.int64() if j > 2 else pa.int32()) for j in range(5)], names=["cluster", "dim", "limb", "n", "part"])

    found = ready.mapInArrow(run, "cluster int, dim int, limb int, n long, part long")
    return found.groupBy("cluster", "dim", "limb").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))


def moved(centroids: Centroids, parts: DataFrame) -> Centroids:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    count: dict[int, int] = {}
    total: dict[int, list[int]] = {}
    for row in parts.toLocalIterator():  # at most centroids x dimensions x limbs rows
        count[row["cluster"]] = count.get(row["cluster"], 0) + row["n"]
        total.setdefault(row["cluster"], [0] * len(centroids.rows[0]))[row["dim"]] += row["part"] << (LIMB * row["limb"])
    return Centroids([[v // count[k] for v in total[k]] if count.get(k) else c for k, c in enumerate(centroids.rows)])


def first_centroids(ready: DataFrame, *, clusters: int, seed: int, scale: int) -> Centroids | None:
    """The vectors with the smallest hashes of seed and identifier."""
    hashed = ready.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    rows = hashed.orderBy(F.asc_nulls_last("h"), "x").limit(clusters).select("x").collect()
    return Centroids([[whole(v, scale) for v in r["x"]] for r in rows]) if rows else None


def assigned(ready: DataFrame, centroids: Centroids, *, scale: int, dimensions: int) -> DataFrame:
    """(id, cluster, distance)."""

    def run(batches):
        for ids, block in _blocks(batches, scale, dimensions):
            best, distance = centroids.nearest(block)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return ready.mapInArrow(run, "id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dimensions: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    if clusters < 1 or rounds < 0 or not 1 <= dimensions <= 64:
        raise ValueError("one cluster or more, no negative number of rounds, and 1 to 64 dimensions are needed")
    ready = taking_part(vectors, dimensions=dimensions, id=id, vector=vector)
    centroids = first_centroids(ready, clusters=clusters, seed=seed, scale=scale)
    if centroids is None:
        return ready.select(F.col("id").alias("vec_id"), *[F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(centroids, sums(ready, centroids, scale=scale, dimensions=dimensions))
    placed = stage(assigned(ready, centroids, scale=scale, dimensions=dimensions), "assigned")
    # one row a cluster; a sum with a distance past 64 bits is past them too
    inner = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    outer = None if None in inner.values() else sum(inner.values())
    fits = lambda v: v if v is not None and v <= _LONGEST else None
    known = sorted(inner)
    value = lambda make, kind: F.element_at(F.create_map(*[F.lit(x) for k in known for x in (k, make(k))]), F.col("cluster")).cast(kind) if known else F.lit(None).cast(kind)
    return placed.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        value(lambda k: None if fits(inner[k]) is None else str(inner[k]), "long").alias("cluster_inertia"),
        F.lit(fits(outer)).cast("long").alias("inertia"),
        value(centroids.digest, "string").alias("centroid_sha256"),
    )
