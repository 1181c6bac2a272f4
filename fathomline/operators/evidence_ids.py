"""Evidence identifiers inside nested JSON of any shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_value(value) -> list[str]:
    """The strings under ``evidence_id`` and in lists under ``evidence_ids``, in the order of the text; a stack instead of recursion, so that no depth is too deep."""
    found, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)  # only names of evidence are put there as strings
        elif isinstance(x, dict):
            for key, item in reversed(x.items()):
                if key == "evidence_id" and isinstance(item, str):
                    stack.append(item)
                elif key == "evidence_ids" and isinstance(item, list):
                    stack += [i for i in reversed(item) if isinstance(i, str)]
                elif isinstance(item, dict | list):
                    stack.append(item)
        elif isinstance(x, list):
            stack += [i for i in reversed(x) if isinstance(i, dict | list)]
    return found


def _parsed(text: str | None) -> list[str]:
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return []
    return list(dict.fromkeys(in_value(value))) if isinstance(value, dict | list) else []


def evidence_ids(rows: DataFrame, id: str, payload: str) -> DataFrame:
    """(id, pos, evidence_id): each identifier of a row's JSON once, by first occurrence from 0. Null, empty or broken JSON has none.

    A payload has no schema that a struct could name, and its depth is open; it is walked inside its row, Arrow batch by Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(t) for t in batch["payload"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.list_(pa.string()))], names=["id", "found"])

    own = rows.select(F.col(id).alias("id"), F.col(payload).alias("payload"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, found array<string>").select(F.col("id").alias(id), F.posexplode("found").alias("pos", "evidence_id"))
