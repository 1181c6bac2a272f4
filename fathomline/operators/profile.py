"""Interest profile and the budgeted selection of discoveries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import PROFILE_STOP, jitter, token_set
from fathomline.operators.ranking import age_days, recency

EXPLICIT_SOURCE = "dashboard_explicit"


def label_weights(events: DataFrame, favourites: DataFrame | None, now: Column) -> DataFrame:
    """Concepts: label, weight, polarity, source.

    events: source, session_fingerprint, kind, label, confidence, explicitness, observed_at; favourites: title, abstract.
    A label weighs confidence x authority x 0.5 ** (age / 180 days) over its events, negatives apart; each distinct token of a favourite adds 1.5.
    The casing of the oldest event is shown."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 86400e6)
    authority = F.when(F.col("source") == EXPLICIT_SOURCE, 2.5).when(F.col("explicitness") == "explicit", 1.0).otherwise(0.65)
    value = F.col("confidence") * authority * F.pow(F.lit(0.5), age / 180.0)
    parts = events.select(
        F.lower("label").alias("key"),
        F.col("label"),
        F.col("observed_at").cast("timestamp").alias("observed_at"),
        F.when(F.col("kind") == "negative", 0.0).otherwise(value).alias("plus"),
        F.when(F.col("kind") == "negative", value).otherwise(0.0).alias("minus"),
        (F.col("source") == EXPLICIT_SOURCE).alias("stated"),
    )
    if favourites is not None:
        liked = favourites.select(F.explode(token_set(F.concat_ws(" ", "title", "abstract"), PROFILE_STOP)).alias("key"))
        parts = parts.unionByName(liked.select("key", F.col("key").alias("label"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit(1.5).alias("plus"), F.lit(0.0).alias("minus"), F.lit(False).alias("stated")))
    far = F.lit("9999-01-01").cast("timestamp")
    grouped = parts.groupBy("key").agg(F.min_by("label", F.struct(F.coalesce("observed_at", far), F.col("label"))).alias("label"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.max("stated").alias("stated"))
    net = F.greatest(F.lit(-3.0), F.least(F.lit(6.0), F.col("plus") - F.col("minus")))
    return grouped.withColumn("net", net).filter(F.abs("net") >= 0.15).select("label", F.round("net", 4).alias("weight"), F.when(F.col("net") < 0, "negative").otherwise("positive").alias("polarity"), F.when(F.col("stated"), "explicit").otherwise("learned").alias("source"))


def top_concepts(weights: DataFrame, concepts: int = 30, positive: int = 24, negative: int = 12) -> DataFrame:
    """The concepts and the labels that a profile keeps, in order: explicit first, then by absolute weight, then label."""
    order = [F.col("source") != "explicit", F.abs("weight").desc(), F.lower("label")]
    ranked = weights.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("nth", F.row_number().over(Window.partitionBy("polarity").orderBy(*order)))
    kept = F.when(F.col("polarity") == "positive", F.col("nth") <= positive).otherwise(F.col("nth") <= negative)
    return ranked.filter((F.col("position") <= concepts) | kept).select("label", "weight", "polarity", "source", (F.col("position") <= concepts).alias("concept"), kept.alias("kept"))


def activation(events: DataFrame, favourites: DataFrame, note: bool = False) -> DataFrame:
    """One row: counts and whether the profile may steer ingestion."""
    e = events.agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("session_fingerprint").alias("session_count"), F.count_if((F.col("explicitness") == "explicit") & (F.col("kind") != "negative")).alias("explicit_event_count"))
    f = favourites.agg(F.count(F.lit(1)).alias("favorite_count"))
    strong = (F.col("event_count") >= 8) & (F.col("session_count") >= 3) & (F.col("explicit_event_count") >= 1)
    return e.crossJoin(f).withColumn("active", (F.col("event_count") > 0) | (F.col("favorite_count") > 0)).withColumn("active_for_ingestion", F.lit(note) | (F.col("favorite_count") >= 3) | strong)


def priority_scores(records: DataFrame, positive: list[str], today: str, *, id: str = "id", semantic: str | None = None, model: str | None = None) -> DataFrame:
    """Affinity, frontier, exploration and relevance of discovery records (title, abstract, published_date, citation_count), rounded to 6 places.

    ``semantic`` and ``model`` name columns with similarity to the profile and a model's relevance, where there are any."""
    terms = F.array(*map(F.lit, positive)) if positive else F.array().cast("array<string>")
    profile = F.array_distinct(terms)
    held = records.withColumn("__t", token_set(F.concat_ws("\n", "title", "abstract"), PROFILE_STOP))
    n = F.greatest(F.lit(1), F.size("__t"))
    token_df = held.select(F.explode("__t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    signals = held.select(F.col(id).alias("__id"), F.explode("__t").alias("token")).join(token_df, "token").groupBy("__id").agg(F.sum(F.when(F.col("df") > 1, F.col("df")).otherwise(0)).alias("topical"), F.sum(1.0 / F.col("df")).alias("rare"))
    age = F.coalesce(age_days(F.col("published_date"), today), F.lit(180))
    raw = F.when(F.col("citation_count").isNull(), None).when(age >= 14, F.log1p(F.col("citation_count").cast("double")) / F.sqrt(F.greatest(F.lit(30), age).cast("double"))).otherwise(0.5)
    held = held.join(signals, F.col(id) == F.col("__id"), "left").withColumn("__raw", raw)
    # the percentile is among all measured records; distinct values are few, so ranks are worked out on them
    values = held.filter("__raw is not null").groupBy("__raw").agg(F.count(F.lit(1)).alias("__equal"))
    placed = values.withColumn("__below", F.coalesce(F.sum("__equal").over(Window.orderBy("__raw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__equal").over(Window.partitionBy(F.lit(0))))
    placed = placed.select(F.col("__raw").alias("__v"), ((F.col("__below") + 0.5 * F.col("__equal")) / F.col("__all")).alias("citation"))
    held = held.join(placed, F.col("__raw") == F.col("__v"), "left")
    overlap = F.size(F.array_intersect("__t", profile))
    lexical = overlap / F.greatest(F.lit(1.0), F.sqrt((F.size(profile) * F.size("__t")).cast("double")))
    affinity = lexical if semantic is None else F.coalesce(0.8 * F.col(semantic) + 0.2 * lexical, lexical)
    if model is not None:
        affinity = F.coalesce(0.45 * affinity + 0.55 * F.col(model), affinity)
    held = held.withColumn("__a", affinity).withColumn("__r", F.coalesce(recency(F.col("published_date"), today), F.lit(0.5)))
    neutral = F.coalesce("citation", F.lit(0.5))
    trend = F.least(F.lit(1.0), F.coalesce("topical", F.lit(0)) / n / 4.0)
    rarity = F.coalesce("rare", F.lit(0.0)) / n
    quality = F.least(F.lit(1.0), F.coalesce(F.length("abstract"), F.lit(0)) / 1200.0)
    return held.select(
        F.col(id),
        F.round("__a", 6).alias("affinity"),
        F.round(0.60 * F.col("__a") + 0.25 * F.col("__r") + 0.15 * neutral, 6).alias("relevance"),
        F.round(0.35 * trend + 0.25 * rarity + 0.15 * quality + 0.15 * F.col("__r") + 0.10 * neutral, 6).alias("frontier"),
        F.round((1.0 - F.col("__a")) * (0.8 + 0.2 * jitter(F.col(id))), 6).alias("exploration"),
        F.round("citation", 6).alias("citation"),
    )


def quotas(candidates: int, budget: int, shares: tuple[float, float, float], active: bool) -> dict[str, int]:
    """Numbers of records a lane takes; 0 as budget means all."""
    if budget < 0:
        raise ValueError("daily enrichment budget cannot be negative")
    if not math.isclose(sum(shares), 1.0, abs_tol=0.001):
        raise ValueError("ingestion lane shares must sum to 1")
    target = candidates if budget == 0 else min(budget, candidates)
    preference, frontier = round(target * shares[0]), round(target * shares[1])
    exploration = target - preference - frontier
    if target >= 2 and exploration == 0:
        exploration, preference = 1, max(0, preference - 1)
    if not active:
        frontier, preference = frontier + preference, 0
    return {"target": target, "preference": preference, "frontier": frontier, "exploration": exploration}


def lanes(scores: DataFrame, budget: int, *, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), active: bool = True, id: str = "id", total: int | None = None) -> DataFrame:
    """Every record with its lane; each lane takes the best that earlier lanes left, what is still missing is taken by the best of any score.

    ``total`` is the number of records where the caller has counted already. Nothing is held in memory: a lane takes its records from the best of
    its own order, of which earlier lanes can have taken no more than they took in all."""
    total = scores.count() if total is None else total
    number = quotas(total, budget, shares, active)
    best = F.greatest("relevance", "frontier", "exploration")
    chosen, left = None, total
    for lane, order in (("preference", F.col("relevance")), ("frontier", F.col("frontier")), ("exploration", F.col("exploration")), ("editorial", best)):
        gone = total - left
        count = min(left, number["target"] - gone if lane == "editorial" else number[lane])
        if count <= 0:
            continue
        rest = scores.select(id, order.alias("by")).orderBy(F.desc("by"), id).limit(count + gone)
        if chosen is not None:
            rest = rest.join(chosen.select(id), id, "left_anti").orderBy(F.desc("by"), id).limit(count)
        taken = rest.select(id, F.lit(lane).alias("lane"))
        chosen, left = taken if chosen is None else chosen.unionByName(taken), left - count
    final = scores.withColumn("final_score", best)
    if chosen is None:
        return final.withColumn("lane", F.lit("deferred"))
    return final.join(chosen, id, "left").withColumn("lane", F.coalesce("lane", F.lit("deferred")))
