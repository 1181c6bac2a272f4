"""Chat history: user turns, budgets, filters, interests stated in plain words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import LEAD_IN, NEGATIVE_CUE, RESEARCH_HINT, redact, squeeze

EVENT = "type string, role string, text string, session_id string, payload struct<type:string, role:string, content:array<struct<type:string, text:string>>>, message struct<role:string, content:string>"


def events_of_lines(raw: DataFrame, line: str = "value") -> DataFrame:
    """Chat events (role, text) of JSON lines in any of the known layouts; malformed lines drop out."""
    parsed = raw.withColumn("e", F.from_json(F.col(line), EVENT)).filter("e is not null")
    blocks = lambda c: F.array_join(F.transform(c, lambda b: b["text"]), "\n")
    listed = F.from_json(F.col("e.message.content"), "array<struct<type:string, text:string>>")
    text = F.coalesce(
        blocks(F.col("e.payload.content")),
        blocks(F.filter(listed, lambda b: b["type"] == "text")),
        F.when(~F.startswith(F.col("e.message.content"), F.lit("[")), F.col("e.message.content")),
        F.col("e.text"),
    )
    role = F.coalesce("e.payload.role", "e.message.role", "e.role", F.when(F.col("e.type").isin("user", "assistant", "system"), F.col("e.type")), F.lit("user"))
    return parsed.select("*", role.alias("role"), text.alias("text")).drop("e").filter("text is not null")


def user_turns(turns: DataFrame, session: str, order: str, *, shortest: int = 20, longest: int = 12_000, last: int = 80) -> DataFrame:
    """The last turns of the user in each session, of fitting length, secrets removed."""
    own = turns.filter((F.col("role") == "user") & F.length(F.trim("text")).between(shortest, longest))
    recent = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return own.withColumn("recent", recent).filter(F.col("recent") <= last).withColumn("text", redact(F.col("text")))


def about_research(text: Column) -> Column:
    return text.rlike(RESEARCH_HINT)


def within_budget(turns: DataFrame, session: str, order: str, *, each: int = 4000, total: int = 24_000) -> DataFrame:
    """Newest first, turns of at most ``each`` characters until ``total`` are used (the last one is clipped), then in their own order."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    clipped = turns.withColumn("text", F.substring("text", 1, each))
    used = clipped.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return used.filter(F.col("before") < total).withColumn("text", F.substring("text", F.lit(1), (F.lit(total) - F.col("before")).cast("int"))).drop("before")


def stated_interests(notes: DataFrame, text: str, *keys: str, most: int = 12) -> DataFrame:
    """(keys, nth, label, kind): the first parts of a note, those with a negative cue apart."""
    parts = F.slice(F.filter(F.transform(F.split(F.col(text), r"[\n.;]+"), squeeze), lambda p: p != ""), 1, most)
    each = notes.select(*keys, F.posexplode(parts).alias("nth", "part"))
    label = F.substring(F.regexp_replace(F.regexp_replace("part", LEAD_IN, ""), "^[ :-]+|[ :-]+$", ""), 1, 160)
    return each.select(*keys, "nth", label.alias("label"), F.when(F.col("part").rlike(NEGATIVE_CUE), "negative").otherwise("positive").alias("kind")).filter(F.length("label") >= 3)
