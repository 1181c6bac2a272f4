"""Weighted BM25 over whole tables.

A search reads the table once for the statistics (number of rows, mean length, rows that match each query item) and once for the
scores; term counts are taken inside each row, so that no posting is shuffled. The statistics are one row.
Many searches at once go through postings instead (:func:`search_many`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import words

K1, B, FLOOR = 1.2, 0.75, 1e-6


def _phrase_count(joined: Column, phrase: list[str]) -> Column:
    """How often the words of ``phrase`` stand next to one another in a text of words that have a space on both sides each."""
    return F.regexp_count(joined, F.lit("(?= " + "  ".join(phrase) + " )"))


def idf(total: Column, matching: Column) -> Column:
    raw = F.log((total - matching + 0.5) / (matching + 0.5))
    return F.when(raw <= 0, F.lit(FLOOR)).otherwise(raw)


def scored(rows: DataFrame, fields: dict[str, float], items: list[list[str]], *, every: bool = False, analyzer=words) -> DataFrame:
    """``rows`` that match, with ``score``: any item, or ``every`` one. Items are phrases of one word or more; a repeated item counts again, an empty one never matches.

    Statistics are those of all ``rows``; filter the result, not the input, to search a part of an index."""
    if every and not all(items):
        items = []
    items = [i for i in items if i]
    if not items:
        return rows.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    base = rows
    asked = sorted({x for i in items for x in i})
    for n in fields:
        base = base.withColumn(f"__t_{n}", analyzer(F.col(n)))
    base = base.withColumn("__len", sum((F.size(f"__t_{n}") for n in fields), F.lit(0)))
    if all(len(i) == 1 for i in items):
        # one pass leaves the few words that are asked for
        for n in fields:
            base = base.withColumn(f"__t_{n}", F.filter(f"__t_{n}", lambda t: t.isin(asked)))
        count = lambda n, item: F.size(F.filter(f"__t_{n}", lambda t: t == item[0]))
    else:
        for n in fields:
            base = base.withColumn(f"__t_{n}", F.concat(F.lit(" "), F.array_join(f"__t_{n}", "  "), F.lit(" ")))
        count = lambda n, item: _phrase_count(F.col(f"__t_{n}"), item)
    weight = [sum((F.lit(float(w)) * count(n, item) for n, w in fields.items()), F.lit(0.0)) for item in items]
    counted = base.withColumn("__tf", F.array(*weight)).drop(*[f"__t_{n}" for n in fields])
    stats = counted.agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg("__len").alias("__avg"),
        F.array(*[F.count_if(F.col("__tf")[k] > 0) for k in range(len(items))]).alias("__df"),
    )
    parts = []
    for k in range(len(items)):
        f = F.col("__tf")[k]
        parts.append(idf(F.col("__n"), F.col("__df")[k]) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg"))))
    hits = sum(((F.col("__tf")[k] > 0).cast("int") for k in range(1, len(items))), (F.col("__tf")[0] > 0).cast("int"))
    # the condition names the statistics, so that it stays above the join and the counts below are worked out once
    enough = F.when(F.col("__n") > 0, hits) >= (len(items) if every else 1)
    return counted.crossJoin(F.broadcast(stats)).filter(enough).withColumn("score", sum(parts[1:], parts[0])).drop("__tf", "__len", "__n", "__avg", "__df")


def search(rows: DataFrame, fields: dict[str, float], items: list[list[str]], *, id: str, limit: int, every: bool = False, keep=None, analyzer=words) -> DataFrame:
    """The best ``limit`` rows by rounded score, ties by identifier; ``keep`` filters after scoring."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    found = scored(rows, fields, items, every=every, analyzer=analyzer)
    if keep is not None:
        found = found.filter(keep)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), id).limit(limit)


def search_many(rows: DataFrame, text: str, id: str, queries: DataFrame, query_id: str, query: str, *, top: int) -> DataFrame:
    """For each row of ``queries`` its ``top`` rows: query_id, id, score, rank. Postings of words that no query has are dropped where they arise."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.slice(words(F.col(query)), 1, 20)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    base = rows.select(F.col(id).alias("id"), words(F.col(text)).alias("t"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avg"))
    postings = base.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    matching = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = postings.join(matching, "term").crossJoin(F.broadcast(stats))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    total = weighted.withColumn("part", part).join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= top)
