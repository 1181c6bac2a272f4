"""Checks that derived records and articles cite only what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_records(records: DataFrame, passages: DataFrame) -> DataFrame:
    """records(record_id, paper_version_id, statement, evidence_ids, numeric_values, confidence) -> the ones that hold.

    A record needs a statement and one distinct evidence id or more, all of passages of its own paper version; each of its numbers must stand
    verbatim in the cited text. Confidence is clamped to 0..1."""
    cited = records.filter(F.trim(F.coalesce("statement", F.lit(""))) != "").withColumn("evidence_ids", F.array_distinct("evidence_ids")).filter(F.size("evidence_ids") > 0)
    each = cited.select("record_id", "paper_version_id", F.explode("evidence_ids").alias("evidence_id"))
    texts = each.join(passages.select("evidence_id", "paper_version_id", "text"), ["evidence_id", "paper_version_id"])
    seen = texts.groupBy("record_id").agg(F.countDistinct("evidence_id").alias("n"), F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("cited_text"))
    ok = cited.join(seen, "record_id").filter(F.col("n") == F.size("evidence_ids")).filter(F.forall(F.coalesce("numeric_values", F.array().cast("array<string>")), lambda v: F.contains(F.col("cited_text"), v)))
    return ok.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))).drop("n", "cited_text")


def with_evidence_ids(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with the ids they cite, by confidence; records that cite nothing drop out."""
    return records.join(links, "record_id").groupBy("record_id", "confidence").agg(F.array_join(F.sort_array(F.collect_list("evidence_id")), ",").alias("evidence_ids")).orderBy(F.desc("confidence"), "record_id")


def missing_ids(asked: DataFrame, stored: DataFrame, id: str) -> DataFrame:
    return asked.select(id).distinct().join(stored.select(id), id, "left_anti").orderBy(id)


def mode_errors(modes: list[str], active: bool) -> list[str]:
    """Rules on the modes of all articles of a digest."""
    n, preference, exploration = len(modes), modes.count("preference"), modes.count("exploration")
    if not active:
        return [] if modes.count("editorial") == n else ["without an active profile all articles are editorial"]
    errors = []
    if preference < 1:
        errors.append("one preference article at least")
    if n > 1 and exploration < 1:
        errors.append("one exploration article at least")
    if n > 1 and preference > n - 1:
        errors.append("not all articles may be preference")
    return errors


def exact_partition(groups: list[dict], ids: list[str]) -> bool:
    """Whether a cluster answer names each paper once, with a title of 2 to 10 words, a description, a problem and a numeric confidence."""
    named = [p for g in groups for p in g.get("paper_ids", [])]
    if sorted(named) != sorted(ids):
        return False
    for g in groups:
        title = str(g.get("title", "")).strip()
        number = g.get("membership_confidence")
        if not 2 <= len(title.split()) <= 10 or len(title) > 100 or not str(g.get("description", "")).strip() or not str(g.get("shared_problem", "")).strip():
            return False
        if isinstance(number, bool) or not isinstance(number, int | float):
            return False
    return True


def complete_batches(scores: DataFrame, batch: str, expected: DataFrame) -> DataFrame:
    """Scores of the batches in which every expected id has a number and a reason; other batches are dropped whole."""
    good = scores.filter(F.col("score").isNotNull() & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    full = good.groupBy(batch).agg(F.countDistinct("id").alias("got")).join(expected.groupBy(batch).agg(F.countDistinct("id").alias("want")), batch).filter("got = want")
    return good.join(full.select(batch), batch, "left_semi")
