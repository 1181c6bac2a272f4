"""What a model says about the relevance of discoveries to a profile, asked in batches where the rows lie."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import squeeze

# Papers a call, characters of an abstract and of a reason.
BATCH, LONGEST_ABSTRACT, LONGEST_REASON = 20, 1800, 240
JUDGED = "id string, relevance double, reason string"


def accepted(ids: list[str], answer) -> list[tuple[str, float, str]]:
    """The scores of an answer that names each of ``ids`` and no other with a number and a reason; none of any other answer."""
    given = answer.get("scores") if isinstance(answer, dict) else None
    found: dict[str, tuple[str, float, str]] = {}
    for x in given if isinstance(given, list) else []:
        if not isinstance(x, dict) or x.get("discovery_id") not in ids:
            continue
        value, reason = x.get("relevance"), " ".join(str(x.get("reason", "")).split())[:LONGEST_REASON]
        if isinstance(value, int | float) and not isinstance(value, bool) and reason:
            found[x["discovery_id"]] = (x["discovery_id"], max(0.0, min(1.0, float(value))), reason)
    return [found[i] for i in ids] if set(found) == set(ids) else []


def judged(rows: DataFrame, provider, positive: list[str], negative: list[str], *, writers: int = 4) -> DataFrame:
    """rows(id, title, abstract) -> :data:`JUDGED` for the batches that were answered in full. The plan asks each time it runs: write its result before using it twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def ask(part: list[dict]) -> pd.DataFrame:
            prompt = "relevance: " + json.dumps({"research_profile": {"positive": positive, "negative": negative}, "papers": part}, sort_keys=True)
            try:
                out = accepted([p["discovery_id"] for p in part], provider.structured(prompt, {"scores": "array<struct<discovery_id:string,relevance:double,reason:string>>"}))
            except (RuntimeError, ValueError, KeyError, IndexError):
                out = []
            return pd.DataFrame(out, columns=["id", "relevance", "reason"])

        for pdf in batches:
            held += pdf.to_dict("records")
            while len(held) >= BATCH:
                yield ask(held[:BATCH])
                held = held[BATCH:]
        if held:
            yield ask(held)

    own = rows.select(F.col("id").cast("string").alias("discovery_id"), F.coalesce("title", F.lit("")).alias("title"), F.substring(squeeze(F.coalesce("abstract", F.lit(""))), 1, LONGEST_ABSTRACT).alias("abstract"))
    return own.repartition(writers, "discovery_id").mapInPandas(run, JUDGED)
