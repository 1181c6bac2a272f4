"""Vector search, reciprocal-rank fusion and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import vectors as v

RRF = 60


def dense_search(rows: DataFrame, vector: str, query: list[float], *, id: str, limit: int) -> DataFrame:
    """Exact cosine top-k against one query vector: id, similarity (rounded), in order."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(id).alias("id"), F.round(v.cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def fused(lexical: DataFrame, dense: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists of (id, score): id, score, reasons, in order; ties go to the lexical list, then to rank."""

    def placed(df: DataFrame, number: int, reason: str) -> DataFrame:
        # at most a hundred rows on each side
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        return df.select("id", rank.alias("rank"), F.lit(number).alias("list"), F.lit(reason).alias("reason"))

    both = placed(lexical, 0, "lexical").unionByName(placed(dense, 1, "semantic"))
    sums = both.groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.concat_ws(",", F.sort_array(F.collect_set("reason"))).alias("reasons"))
    return sums.orderBy(F.desc("score"), "first", "id").limit(limit).select("id", "score", "reasons")


def coverage(eligible: DataFrame, embedded: DataFrame, id: str) -> DataFrame:
    """One row: eligible passages, those with a vector, and their share."""
    have = eligible.join(embedded.select(id).distinct(), id, "left_semi").agg(F.count(F.lit(1)).alias("embedded"))
    return eligible.agg(F.count(F.lit(1)).alias("eligible")).crossJoin(have).withColumn("share", F.round(F.when(F.col("eligible") > 0, F.col("embedded") / F.col("eligible")).otherwise(0.0), 6))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): the normalised mean vector of each group, aggregated by dimension."""
    means = rows.select(F.col(group).alias("group"), F.posexplode(vector).alias("dim", "x")).groupBy("group", "dim").agg(F.avg("x").alias("m"))
    length = means.groupBy("group").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return means.join(length, "group").select("group", "dim", F.when(F.col("n") == 0, F.col("m")).otherwise(F.col("m") / F.col("n")).alias("value"))


def novelty_cut(ranked: DataFrame, papers: int) -> DataFrame:
    """ranked(rank, paper): passages until ``papers`` papers and twice as many passages are reached; once enough papers are seen, repeats are skipped."""
    order = Window.orderBy("rank")
    first = ranked.withColumn("fresh", (F.row_number().over(Window.partitionBy("paper").orderBy("rank")) == 1).cast("int"))
    seen = first.withColumn("before", F.coalesce(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = seen.filter((F.col("fresh") == 1) | (F.col("before") < papers))
    counted = taken.withColumn("passages", F.row_number().over(order)).withColumn("papers", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = (F.col("papers") >= papers) & (F.col("passages") >= 2 * papers)
    stop = F.coalesce(F.max(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("stop", stop).filter("stop = 0").select("rank", "paper")
