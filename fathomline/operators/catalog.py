"""Catalog of discoveries: canonical rows, filters, segments, counts, snapshots and their coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(records: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each ``key``: acquired before others, then by ``order``. The catalog is de-duplicated before any filter."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("status") == "acquired", 0).otherwise(1), *order))
    return records.withColumn("__n", first).filter("__n = 1").drop("__n")


def category_filter(category: str, primary_only: bool, *, primary: str = "primary_category", categories: str = "categories") -> Column:
    own = F.col(primary) == category
    return own if primary_only else own | F.array_contains(categories, category)


def date_filter(column: str, start: str | None, end: str | None) -> Column:
    """Inclusive range on ISO text; rows without a date drop out if a bound is given."""
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= start)
    if end:
        out = out & (F.col(column) <= end)
    return out


def month_segments(spark, start: str, end: str) -> DataFrame:
    """(segment_start, segment_end): calendar-month pieces of an inclusive range."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("m", F.lit(start).cast("date")).alias("segment_start"), F.least(F.last_day("m"), F.lit(end).cast("date")).alias("segment_end"))


def status_counts(records: DataFrame, group: str, primary: Column) -> DataFrame:
    """Per group: discovered, acquired and failed, and the same for primary rows; empty groups count 0."""
    return records.groupBy(group).agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(F.col("status") == "acquired").alias("acquired"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(primary).alias("primary_total"),
        F.count_if(primary & (F.col("status") == "acquired")).alias("primary_acquired"),
        F.count_if(primary & (F.col("status") == "failed")).alias("primary_failed"),
    ).withColumn("primary_pending", F.col("primary_total") - F.col("primary_acquired") - F.col("primary_failed"))


def coverage(records: DataFrame, *, category: str, primary_only: bool, start: str | None, end: str | None, key: str = "source_id", order: Column) -> DataFrame:
    """One row: catalog, full-text and unavailable papers among the canonical rows of the filtered catalog. A missing bound compares as null, so that nothing counts."""
    bounds = (F.col("published_date") >= F.lit(start)) & (F.col("published_date") <= F.lit(end))
    kept = canonical(records.filter(bounds).filter(category_filter(category, primary_only)), key, order)
    return kept.agg(F.count(F.lit(1)).alias("catalog_papers"), F.coalesce(F.count_if(F.col("status") == "acquired"), F.lit(0)).alias("full_text_papers"), F.coalesce(F.count_if(F.col("status") == "failed"), F.lit(0)).alias("unavailable_papers"))


SNAPSHOT_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,79}")


def snapshot_members(papers: DataFrame, versions: DataFrame, *, start: str | None = None, end: str | None = None, synthetic: bool = False, discoveries: DataFrame | None = None, category: str | None = None, primary_only: bool = False) -> DataFrame:
    """(paper_id, paper_version_id) of the current versions that a snapshot pins."""
    kept = papers.filter(date_filter("published_date", start, end))
    if not synthetic:
        kept = kept.filter(F.col("source_class") != "synthetic")
    if category:
        kept = kept.join(discoveries.filter(category_filter(category, primary_only)).select(F.col("paper_id").alias("id")), "id", "left_semi")
    return kept.join(versions.filter("is_current").select(F.col("id").alias("paper_version_id"), "paper_id"), kept["id"] == F.col("paper_id")).select("paper_id", "paper_version_id")


def known_gaps(unavailable: int, embeddings: int, records: int) -> list[str]:
    gaps = ["Only explicitly imported papers are included.", "Novelty and opportunity analysis are bounded by this corpus."]
    if unavailable:
        gaps.append(f"{unavailable} catalog papers had no retrievable full text.")
    if not embeddings:
        gaps.append("No semantic embeddings were published in this snapshot.")
    if not records:
        gaps.append("No structured scientific records were published in this snapshot.")
    return gaps


def per_day(rows: DataFrame, day: Column, most: int = 30) -> DataFrame:
    """The newest days with their counts, oldest first."""
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("day")).limit(most).orderBy("day")


def theme_counts(rows: DataFrame, themes: str, order: list[Column], newest: int = 30, most: int = 12) -> DataFrame:
    """Themes of the newest rows by count, ties by name."""
    return rows.orderBy(*order).limit(newest).select(F.explode(themes).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "theme").limit(most)


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("position") <= k)
