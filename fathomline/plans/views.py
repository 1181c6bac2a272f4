"""How the driver's tables stand in for the engine's own: papers, events, discoveries, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2026-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 745).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.col("doc_id").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        day.alias("published_date"),
        F.when(F.col("source") == "src3", "synthetic").otherwise("imported").alias("source_class"),
        F.when(F.col("lang") == "es", None).otherwise((F.col("n_chars") % 500).cast("int")).alias("citation_count"),
        "lang",
        "source",
    )


PAPERS = """papers AS (
    SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract,
           strftime(DATE '2024-01-01' + CAST(doc_id % 745 AS INTEGER), '%Y-%m-%d') AS published_date,
           CASE WHEN source = 'src3' THEN 'synthetic' ELSE 'imported' END AS source_class,
           CASE WHEN lang = 'es' THEN NULL ELSE CAST(n_chars % 500 AS INTEGER) END AS citation_count, lang, source
    FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = F.concat_ws("-", "event_type", (F.col("user_id") % 12).cast("string"))
    return e.select(
        "event_id",
        F.when(F.col("user_id") % 10 == 0, "dashboard_explicit").when(F.col("user_id") % 2 == 0, "codex").otherwise("claude").alias("source"),
        F.col("user_id").cast("string").alias("session_fingerprint"),
        F.when(F.col("event_type") == "error", "negative").otherwise("topic").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.upper(label)).otherwise(label).alias("label"),
        (F.col("value") / 500.0).alias("confidence"),
        F.when(F.col("value") > 250, "explicit").otherwise("inferred").alias("explicitness"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        "event_type",
        "props",
    )


EVENTS = """pref AS (
    SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'dashboard_explicit' WHEN user_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source,
           CAST(user_id AS VARCHAR) AS session_fingerprint, CASE WHEN event_type = 'error' THEN 'negative' ELSE 'topic' END AS kind,
           CASE WHEN event_id % 3 = 0 THEN upper(event_type || '-' || (user_id % 12)) ELSE event_type || '-' || (user_id % 12) END AS label,
           value / 500.0 AS confidence, CASE WHEN value > 250 THEN 'explicit' ELSE 'inferred' END AS explicitness, ts AS observed_at, event_type, props
    FROM events)"""


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "acquired").when(F.col("o_orderstatus") == "P", "failed").otherwise("discovered").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        F.col("o_orderpriority").alias("primary_category"),
        F.array("o_orderpriority", F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string"))).alias("categories"),
        F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string")).alias("group_id"),
    )


DISCOVERIES = """disc AS (
    SELECT o_orderkey AS id, 's' || o_custkey AS source_id,
           CASE o_orderstatus WHEN 'F' THEN 'acquired' WHEN 'P' THEN 'failed' ELSE 'discovered' END AS status,
           strftime(o_orderdate, '%Y-%m-%d') AS published_date, o_orderpriority AS primary_category,
           [o_orderpriority, 'c' || (o_custkey % 4)] AS categories, 'g' || (o_orderkey % 7) AS group_id
    FROM orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.functions.vectors import as_double

    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", as_double(F.col("embedding")).alias("v"), "label")


VECTORS = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
