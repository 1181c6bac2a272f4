"""Writers' merge rules over immutable tables: each takes what is stored and what comes in and returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """First write wins: only keys that aren't stored yet come in."""
    fresh = incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh)


def last_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Incoming rows replace stored ones of their key; ``order`` (descending) chooses among incoming rows of one key."""
    by = Window.partitionBy(*keys).orderBy(F.desc("__new"), *([order.desc()] if order is not None else []))
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__new")


def keep_nonempty(stored: DataFrame, incoming: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Stored rows win except in ``fill``, where an incoming value that is not empty replaces a stored one; other columns never change. New keys come in whole."""
    a, b = stored.alias("a"), incoming.dropDuplicates([key]).alias("b")
    columns = []
    for c in stored.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == key:
            columns.append(F.coalesce(old, new).alias(c))
        elif c in fill:
            columns.append(F.when(F.col(f"a.{key}").isNull() | (new.isNotNull() & (new.cast("string") != "")), new).otherwise(old).alias(c))
        else:
            columns.append(F.when(F.col(f"a.{key}").isNull(), new).otherwise(old).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def replace_group(stored: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """All stored rows of the incoming rows' groups go, the incoming rows take their place."""
    return stored.join(incoming.select(*group).distinct(), group, "left_anti").unionByName(incoming)


def cascade_delete(child: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(gone.select(*keys).distinct(), keys, "left_anti")


def flip_current(versions: DataFrame, *, paper: str = "paper_id", order: list[Column]) -> DataFrame:
    """``is_current`` on the version of each paper that was acquired last."""
    newest = F.row_number().over(Window.partitionBy(paper).orderBy(*order)) == 1
    return versions.withColumn("is_current", newest)


def carry_over(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """New discoveries take status and paper of the latest earlier acquisition of their source identifier."""
    known = earlier.filter("status = 'acquired'").groupBy("source_id").agg(F.max_by("paper_id", F.struct("discovered_at", "paper_id")).alias("__paper"))
    joined = incoming.join(known, "source_id", "left")
    return joined.withColumn("status", F.when(F.col("__paper").isNotNull(), "acquired").otherwise(F.col("status"))).withColumn("paper_id", F.coalesce("__paper", "paper_id")).drop("__paper")


def same_members(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables have the same set of keys: both differences are empty."""
    return a.select(*keys).subtract(b.select(*keys)).isEmpty() and b.select(*keys).subtract(a.select(*keys)).isEmpty()
