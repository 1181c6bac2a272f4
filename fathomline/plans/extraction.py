"""Structured extraction: what is pending, provider calls where the rows lie, records that cite only real evidence, and a log that lets a run resume."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.operators import evidence
from fathomline.plans.engine import Engine

# The kinds of records.
TYPES = ("contribution", "method", "assumption", "empirical_result", "limitation", "future_work")
RECORD = "title string, statement string, evidence_ids array<string>, numeric_values array<string>, confidence double"
PASSAGES, CHARACTERS = 80, 2400  # what one prompt shows


def pending(versions: DataFrame, types: DataFrame, done: DataFrame) -> DataFrame:
    """(paper_version_id, record_type) that have no entry in ``done`` (paper_version_id, record_type)."""
    return versions.select("paper_version_id").crossJoin(F.broadcast(types.select("record_type"))).join(done.select("paper_version_id", "record_type"), ["paper_version_id", "record_type"], "left_anti")


def shown_evidence(passages: DataFrame, most: int = PASSAGES, characters: int = CHARACTERS) -> DataFrame:
    """(paper_version_id, shown): the first ``most`` passages(evidence_id, paper_version_id, ordinal, heading, text) of each version, by section and id, cut to ``characters``."""
    nth = F.row_number().over(Window.partitionBy("paper_version_id").orderBy("ordinal", "evidence_id"))
    line = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] SECTION="), F.coalesce("heading", F.lit("")), F.lit("\n"), F.substring("text", 1, characters))
    first = passages.withColumn("n", nth).filter(F.col("n") <= most).withColumn("line", line)
    return first.groupBy("paper_version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("shown"))


def _plain(item) -> dict | None:
    """A provider's record in the shape of RECORD; None where it has another one."""
    if not isinstance(item, dict):
        return None
    try:
        confidence = float(item.get("confidence") or 0.0)
    except (TypeError, ValueError):
        return None
    cited = [str(e).strip().removeprefix("[").removesuffix("]") for e in item.get("evidence_ids") or []]
    return {"title": item.get("title") or None, "statement": item.get("statement") or None, "evidence_ids": list(dict.fromkeys(cited)), "numeric_values": [str(v) for v in item.get("numeric_values") or []], "confidence": confidence}


def asked(jobs: DataFrame, provider) -> DataFrame:
    """jobs(paper_version_id, record_type, title, abstract, shown) with ``given``, how many records came, and ``records``, those of the right shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [provider.structured("extract " + json.dumps({"record_type": j.record_type, "title": j.title, "abstract": j.abstract, "evidence": j.shown}), {"records": RECORD}).get("records") or [] for j in pdf.itertuples()]
            yield pd.DataFrame({"paper_version_id": pdf["paper_version_id"], "record_type": pdf["record_type"], "given": [len(a) for a in answers], "records": [[r for r in map(_plain, a) if r] for a in answers]})

    return jobs.mapInPandas(run, f"paper_version_id string, record_type string, given int, records array<struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>>")


def extract(engine: Engine, *, paper_id: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, types: tuple[str, ...] = TYPES, skip_completed: bool = False) -> dict:
    """Records of the current versions, oldest papers first; ``skip_completed`` leaves out what this model has answered before.

    A version's records of a type and model are replaced together with their links, and the log says how many were kept and refused."""
    unknown = set(types) - set(TYPES)
    if unknown:
        raise ValueError(f"Unknown extraction types: {', '.join(sorted(unknown))}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    spark, store, model = engine.spark, engine.store, engine.model
    papers = store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), "abstract", "published_date", "created_at")
    versions = store.read("paper_versions").filter("is_current").select(F.col("id").alias("paper_version_id"), "paper_id").join(papers, "paper_id")
    for value, keep in ((paper_id, F.col("paper_id") == paper_id), (start, F.col("published_date") >= start), (end, F.col("published_date") <= end)):
        if value:
            versions = versions.filter(keep)
    if limit is not None:
        versions = versions.orderBy("published_date", "created_at", "paper_id").limit(limit)
    n_papers = versions.count()
    if paper_id and not n_papers:
        raise KeyError(f"Unknown paper: {paper_id}")
    log = store.read("scientific_extractions")
    mine = log.filter(F.col("extractor_version") == model)
    kinds = spark.createDataFrame([(k,) for k in types], "record_type string")
    sections = store.read("sections").select(F.col("id").alias("section_id"), "ordinal", "heading")
    passages = store.read("evidence_passages").select(F.col("id").alias("evidence_id"), "paper_version_id", "section_id", "text")
    shown = shown_evidence(passages.join(sections, "section_id"))
    jobs = pending(versions, kinds, mine if skip_completed else mine.limit(0)).join(versions, "paper_version_id").join(shown, "paper_version_id", "left")
    # providers answer once: their answers are cut from the plan before they are counted, checked and stored
    answers = asked(jobs.select("paper_version_id", "record_type", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("shown", F.lit("")).alias("shown")), engine.provider)
    with store.scratch() as path:
        answers.write.parquet(path)
        total = _store_answers(engine, spark.read.parquet(path), passages, versions, log)
    return {"status": "enriched", "paper_count": n_papers, "accepted_records": total["kept"], "rejected_records": total["refused"], "extraction_types": list(types)}


def _store_answers(engine: Engine, answers: DataFrame, passages: DataFrame, versions: DataFrame, log: DataFrame):
    store, model = engine.store, engine.model
    each = answers.select("paper_version_id", "record_type", F.explode("records").alias("r")).select("paper_version_id", "record_type", "r.*")
    named = each.withColumn("record_id", t.stable_id("record", F.col("paper_version_id"), F.col("record_type"), F.col("statement"), F.array_join(F.sort_array("evidence_ids"), "\x1f"))).dropDuplicates(["record_id"])
    good = evidence.valid_records(named, passages)
    owner = versions.select("paper_version_id", "paper_id")
    title = F.coalesce("title", F.initcap(F.replace(F.col("record_type"), F.lit("_"), F.lit(" "))))
    rows = good.join(owner, "paper_version_id").select(F.col("record_id").alias("id"), "paper_id", "paper_version_id", "record_type", title.alias("title"), "statement", F.array().cast("array<string>").alias("conditions"), "numeric_values", "confidence", F.lit(model).alias("extractor_version"), F.current_timestamp().alias("created_at"))
    records = store.read("scientific_records")
    replaced = records.filter(F.col("extractor_version") == model).join(answers, ["paper_version_id", "record_type"], "left_semi").select("id")
    kept = good.groupBy("paper_version_id", "record_type").agg(F.count(F.lit(1)).cast("int").alias("record_count"))
    entries = answers.join(kept, ["paper_version_id", "record_type"], "left").fillna(0, ["record_count"])
    entries = entries.select("paper_version_id", "record_type", F.lit(model).alias("extractor_version"), F.lit("complete").alias("status"), "record_count", (F.col("given") - F.col("record_count")).alias("rejected_count"), F.current_timestamp().alias("completed_at"))
    total = entries.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("kept"), F.coalesce(F.sum("rejected_count"), F.lit(0)).alias("refused")).first()
    with store.transaction() as change:  # records, their links and the log, or none of them
        change.replace("record_evidence", good.select("record_id", F.explode("evidence_ids").alias("evidence_id"), F.lit("supports").alias("relation")), replaced.withColumnRenamed("id", "record_id"))
        change.replace("scientific_records", rows, replaced)
        change.upsert("scientific_extractions", entries)
    return total
