"""Citation counts from a metadata service, asked in batches where the rows lie."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "id string, work_id string, citation_count int, influential_citation_count int, reference_count int, state string, message string"
FIELDS = ("citationCount", "influentialCitationCount", "referenceCount")
# The largest batch, how often a busy service is asked, the longest pause between.
LARGEST_BATCH, TRIES, LONGEST_PAUSE = 500, 4, 8.0


class Busy(RuntimeError):
    """The service asks for patience; ``after`` seconds if it says how long."""

    def __init__(self, message: str = "too many requests", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def patient(lookup: Callable, keys: list[str], sleep: Callable[[float], None] = time.sleep) -> list:
    """The answers of ``lookup``, one for each key; a busy service is asked again."""
    for attempt in range(TRIES):
        try:
            answers = lookup(keys)
            break
        except Busy as busy:
            if attempt + 1 == TRIES:
                raise
            sleep(min(LONGEST_PAUSE, max(1.0, busy.after) if busy.after else 2.0**attempt))
    if not isinstance(answers, list) or len(answers) != len(keys):
        raise RuntimeError("the service returned an invalid batch")
    return answers


def _row(id: str, answer) -> tuple:
    if not isinstance(answer, dict) or not answer.get("paperId"):
        return (id, None, None, None, None, "unmatched", None)
    counts = [answer.get(f) for f in FIELDS]
    if not all(isinstance(c, int) and not isinstance(c, bool) and c >= 0 for c in counts):
        return (id, None, None, None, None, "invalid", "a count is no whole number from 0")
    return (id, str(answer["paperId"]), *counts, "ok", None)


def asked(rows: DataFrame, provider, *, batch: int = LARGEST_BATCH, writers: int = 1) -> DataFrame:
    """rows(id, key) -> :data:`ANSWER`, a row for each; answers belong to keys by their position in a batch.

    ``writers`` tasks ask at the same time; each fills its batches across Arrow's. A batch that fails is told of in each of its rows and stops nothing else. The plan asks each time it runs: write its result before using it twice."""
    if not 1 <= batch <= LARGEST_BATCH:
        raise ValueError(f"a batch has between 1 and {LARGEST_BATCH} keys")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []

        def ask(part: list[tuple[str, str]]) -> list[tuple]:
            try:
                return [_row(id, a) for (id, _), a in zip(part, patient(provider.lookup, [k for _, k in part]), strict=True)]
            except Exception as error:  # noqa: BLE001  counts are an extra; the batch's failure is its result
                return [(id, None, None, None, None, "failed", f"{type(error).__name__}: {error}"[:500]) for id, _ in part]

        def frame(out: list[tuple]) -> pd.DataFrame:
            counts = ("citation_count", "influential_citation_count", "reference_count")
            return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")]).astype({c: "Int32" for c in counts})

        for pdf in batches:
            held += zip(pdf["id"], pdf["key"], strict=True)
            whole = len(held) // batch * batch
            yield frame([row for a in range(0, whole, batch) for row in ask(held[a : a + batch])])
            held = held[whole:]
        if held:
            yield frame(ask(held))

    return rows.select(F.col("id").cast("string").alias("id"), F.col("key").cast("string").alias("key")).repartition(writers, "key").mapInPandas(run, ANSWER)


def merged(stored: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The counts known after a round: new ones where the service had them, else those of before. (key, work_id, the three counts)"""
    columns = [key, "work_id", "citation_count", "influential_citation_count", "reference_count"]
    fresh = answers.filter("state = 'ok'").select(F.col("id").alias(key), *columns[1:])
    return stored.select(*columns).join(fresh.select(key), key, "left_anti").unionByName(fresh)


def tally(answers: DataFrame) -> DataFrame:
    """One row: how many were asked, refreshed, unmatched, invalid and in failed batches."""
    count = lambda s: F.count_if(F.col("state") == s)
    return answers.agg(F.count(F.lit(1)).alias("eligible"), count("ok").alias("refreshed"), count("unmatched").alias("unmatched"), count("invalid").alias("invalid"), count("failed").alias("failed"))
