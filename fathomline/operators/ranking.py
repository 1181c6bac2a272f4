"""The explainable ranker of paper groups."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import RANKING_STOP, token_set

HALF_LIFE = 180


def age_days(date: Column, today: str) -> Column:
    """Days since an ISO date, 0 for later ones; null if it can't be read."""
    days = F.datediff(F.lit(today).cast("date"), F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd"))
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))  # greatest() alone would turn null into 0


def six_places(value: Column) -> Column:
    """Rounded to six places as the double it is: what lies just under a half goes down, where F.round(value, 6) takes its shortest decimal form for it and goes up."""
    return F.round(value * 1e6) / 1e6


@cache
def _halving() -> list[list[float]]:
    """For each day of a half-life the share of it that has gone and 2 to its negative, as two doubles each that add up to it."""
    with localcontext(prec=60):
        pairs = [(Decimal(2) ** -share, share) for share in (Decimal(day) / HALF_LIFE for day in range(HALF_LIFE))]
        return [[x for value in pair for x in (float(value), float(value - Decimal(float(value))))] for pair in pairs]


def recency(date: Column, today: str) -> Column:
    """2 to the negative number of half-lives, to the last bit: pow() may be one bit off, and strengths that are equal, as an affinity and a recency of 2 ** -1.5, would not be so."""
    days = age_days(date, today)
    whole = F.floor(days / HALF_LIFE)
    table = F.element_at(F.lit(_halving()), F.pmod(days, F.lit(HALF_LIFE)).cast("int") + 1)
    value, rest, share, below = (table[k] for k in range(4))
    over = days / float(HALF_LIFE) - whole - share - below  # of the quotient as a double, over the share itself
    return (value + (rest - value * (math.log(2) * over))) * F.pow(F.lit(2.0), -whole)


def affinity(tokens: Column, positive: list[str], negative: list[str]) -> Column:
    """Three times the positive overlap less twice the negative one, each over the geometric mean of the set sizes, within 0..1."""

    def overlap(terms: list[str]) -> Column:
        if not terms:
            return F.lit(0.0)
        return F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms)))) / F.greatest(F.lit(1.0), F.sqrt((F.size(tokens) * len(terms)).cast("double")))

    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), overlap(positive) * 3.0 - overlap(negative) * 2.0)))


def with_citation_percentile(rows: DataFrame, today: str, groups: list[str], *, date: str = "published_date", count: str = "citation_count") -> DataFrame:
    """Adds ``citation``: the mid-rank of log citations inside the group's age cohort; 0.5 for papers under 14 days and for cohorts of one."""
    age = age_days(F.col(date), today)
    cohort = F.when(F.col(count).isNull() | age.isNull() | (age < 14), None).when(age < 30, "30").when(age < 90, "90").when(age < 365, "365").otherwise("old")
    held = rows.withColumn("__age", age).withColumn("__cohort", cohort).withColumn("__log", F.log1p(F.greatest(F.lit(0), F.col(count)).cast("double")))
    by = Window.partitionBy(*groups, "__cohort")
    below = F.rank().over(by.orderBy("__log")) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*groups, "__cohort", "__log"))
    n = F.count(F.lit(1)).over(by)
    value = F.when(F.col(count).isNull() | F.col("__age").isNull(), None).when(F.col("__age") < 14, 0.5).when(n == 1, 0.5).otherwise((below + (equal - 1) / 2) / (n - 1))
    return held.withColumn("citation", value).drop("__age", "__cohort", "__log")


def ranked_groups(rows: DataFrame, *, today: str, positive: list[str], negative: list[str], active: bool, groups: list[str]) -> DataFrame:
    """Positions of papers inside their groups with score, components and up to two reasons.

    rows: paper_id, title, abstract, published_date, similarity, citation_count, is_new and the group columns."""
    personal = bool(active and positive)
    held = with_citation_percentile(rows, today, groups)
    held = held.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("similarity").cast("double"), F.lit(0.0)))))
    held = held.withColumn("recency", recency(F.col("published_date"), today))
    tokens = token_set(F.concat_ws(" ", "title", "abstract"), RANKING_STOP)
    held = held.withColumn("affinity", affinity(tokens, positive, negative) if personal else F.lit(None).cast("double"))
    weights = {"similarity": 0.30, "affinity": 0.30, "recency": 0.25, "citation": 0.15} if personal else {"similarity": 0.50, "recency": 0.35, "citation": 0.15}
    total = sum((F.when(F.col(c).isNotNull(), w * F.col(c)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    parts = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    held = held.withColumn("score", six_places(total / parts))

    def reason(condition: Column, strength: Column, label: str) -> Column:
        return F.when(condition, F.struct((-strength).alias("s"), F.lit(label).alias("label")))

    candidates = F.array_compact(
        F.array(
            reason(F.col("affinity") >= 0.25, F.col("affinity"), "Strong match to your interests"),
            reason(F.coalesce(F.col("is_new"), F.lit(False)) | (F.coalesce(F.col("recency"), F.lit(0.0)) >= 0.9), F.coalesce(F.when(F.col("recency") != 0, F.col("recency")), F.lit(0.9)), "New this month"),
            reason(F.col("citation") >= 0.75, F.col("citation"), "Highly cited for its age"),
            reason(F.col("similarity") >= 0.7, F.col("similarity"), "Central to this neighborhood"),
        )
    )
    held = held.withColumn("reasons", F.concat_ws("; ", F.transform(F.slice(F.array_sort(candidates), 1, 2), lambda r: r["label"])))
    day = F.coalesce(F.datediff(F.try_to_date(F.substring("published_date", 1, 10), "yyyy-MM-dd"), F.lit("0001-01-01").cast("date")), F.lit(-1))
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), day.desc(), F.desc("similarity"), F.asc_nulls_last(F.lower("title")), F.col("paper_id").cast("string"))
    for c in ("affinity", "recency", "citation"):
        held = held.withColumn(c, six_places(F.col(c)))
    return held.withColumn("position", F.row_number().over(order)).withColumn("similarity", F.round("similarity", 6))
