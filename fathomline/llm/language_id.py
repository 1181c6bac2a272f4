"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ``profile_size`` most frequent letter n-grams (n = 1 to 3, word edges marked) of a language, by rank. A document's
own ranked n-grams are compared with each profile: the out-of-place distance is the sum over the document's n-grams of the
difference in rank, or ``profile_size`` where the profile lacks the n-gram. The nearest profile wins, ties to the smaller name.

Profiles are fitted on ``rows_per_language`` labelled documents of each language (all, where there are fewer), the ones with the smallest hashes of
identifier and whole text; equal rows count as often as they occur. Every label is learned, so that the profiles, ``profile_size`` codes a label, are what reaches the driver.
Prediction reads every whole text. Word-edge marks never join into an n-gram across words.

Defined cases: null text or text without a letter gives ``und`` with score 0; with no labelled rows everything is ``und``;
null identifiers count as not held out and are never fitted on; other columns are ignored, but for input columns named like the two added, which those replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter n-grams of ``text`` and their counts; letters are lower-cased, all else is a word edge (0)."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, where = np.unique(points, return_inverse=True)
    letters = np.array([int(p) if chr(p).isalpha() else 0 for p in kinds.tolist()], dtype=np.int64)
    c = np.concatenate(([0], letters[where], [0]))
    if not c.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))  # one edge between words
    c = c[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    one = c[c != 0]
    # a trigram with an edge in its middle would join two words; a mark on bigrams keeps the lengths apart
    codes, counts = np.unique(np.concatenate((one, two | (1 << 62), three[c[1:-1] != 0])), return_counts=True)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Ranked n-grams of each language, laid out for one sorted lookup."""

    def __init__(self, tops: dict[str, np.ndarray], size: int) -> None:
        self.languages, self.size = sorted(tops), size
        every = np.concatenate([tops[x] for x in self.languages]) if tops else np.empty(0, np.int64)
        sizes = [len(tops[x]) for x in self.languages]
        order = np.argsort(every, kind="stable")
        self.codes, self.start = np.unique(every[order], return_index=True)
        self.start = np.append(self.start, len(every))
        # which languages rank a code, and where: as many entries as the profiles have
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.arange(n) for n in sizes])[order] if sizes else np.empty(0, np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 minus its distance over the largest possible one."""
        codes, counts = grams(text)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        place = np.flatnonzero(self.codes[at] == own)
        first, counted = self.start[at[place]], np.diff(self.start)[at[place]]
        ends = np.cumsum(counted)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counted), counted)
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, counted))
        distance = self.size * len(own) - np.bincount(self.owner[entry], nearer, len(self.languages)).astype(np.int64)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def fit(labelled: DataFrame, *, rows_per_language: int = 1000, profile_size: int = 400) -> Profiles:
    """labelled(id, text, lang), all non-null. What reaches the driver is ``profile_size`` n-grams a language."""
    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)))
    # a bound on the hashes of each language that leaves rows_per_language rows at least, from counts by the hash's first bits
    bins = hashed.groupBy("lang", F.shiftright("h", 28).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = bins.withColumn("before", before).filter(F.col("before") < rows_per_language).groupBy("lang").agg(F.max("bin").alias("last"))
    # a row a label, less than the profiles that reach the driver; a join that deals rows by label would bring most of the texts to one task
    thin = hashed.join(F.broadcast(last), "lang").filter(F.shiftright("h", 28) <= F.col("last"))
    # equal rows are one row with their number, so that no group of copies comes to one task
    folded = thin.groupBy("lang", "h", "id", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    taken = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = folded.withColumn("taken", taken).filter(F.col("taken") < rows_per_language).select("lang", "text", F.least("copies", F.lit(rows_per_language) - F.col("taken")).alias("copies"))

    def count(batches):
        for batch in batches:
            sums: dict[str, list] = {}
            for text, lang, copies in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["copies"].to_pylist(), strict=True):
                codes, counts = grams(text)
                sums.setdefault(lang, []).append((codes, counts * copies))
            for lang, parts in sums.items():
                codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], names=["lang", "code", "n"])

    totals = sample.select("text", "lang", "copies").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= profile_size)
    tops: dict[str, list] = {}
    for row in best.orderBy("lang", "r").collect():
        tops.setdefault(row["lang"], []).append(row["code"])
    return Profiles({k: np.array(v, np.int64) for k, v in tops.items()}, profile_size)


def held_out(id):
    """True where crc32 of the identifier's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    schema = docs.schema

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang_pred string", "score double"]))


def fit_documents(docs: DataFrame, *, text: str = "text", lang: str = "lang", id: str = "doc_id", rows_per_language: int = 1000, profile_size: int = 400) -> Profiles:
    """Profiles from the rows with text, language and identifier that aren't held out."""
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("id is not null and text is not null and lang is not null").filter(~held_out(F.col("id")))
    return fit(own, rows_per_language=rows_per_language, profile_size=profile_size)
