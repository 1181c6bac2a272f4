"""Queries: catalog, snapshots, writers, ranking, profile, lanes, parsing, history, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.operators import catalog, evidence, history, parse, profile, ranking, upsert
from fathomline.plans.views import TODAY, discoveries, events, papers, table, vectors
from fathomline.sources.shared import staged

CATEGORY = "1-URGENT"
LIKES = ["the", "thly", "tion", "ering", "und", "que"]
DISLIKES = ["nicht", "leaux", "ing"]


# catalog


def canonical_catalog(spark, sf_dir):
    return catalog.canonical(discoveries(spark, sf_dir), "source_id", F.desc("published_date"), F.desc("id")).select("source_id", "id", "status", "published_date")


def catalog_filters(spark, sf_dir):
    kept = discoveries(spark, sf_dir).filter(catalog.category_filter("c1", False)).filter(catalog.date_filter("published_date", "1996-01-01", "1998-06-30"))
    return kept.groupBy("primary_category", "status").agg(F.count(F.lit(1)).alias("n"), F.min("published_date").alias("first_date"))


def group_status_counts(spark, sf_dir):
    return catalog.status_counts(discoveries(spark, sf_dir), "group_id", F.col("primary_category") == CATEGORY)


def corpus_status(spark, sf_dir):
    d = discoveries(spark, sf_dir).agg(F.countDistinct("source_id").alias("catalog_papers"))
    for name, source in (("full_text_papers", "documents"), ("embeddings", "embeddings"), ("records", "labels"), ("turns", "conversations")):
        d = d.crossJoin(table(spark, sf_dir, source).agg(F.count(F.lit(1)).alias(name)))
    return d


def papers_per_day(spark, sf_dir):
    return catalog.per_day(discoveries(spark, sf_dir), F.col("published_date"))


def theme_counts(spark, sf_dir):
    own = papers(spark, sf_dir).withColumn("themes", F.slice(t.token_set(F.col("title"), t.PROFILE_STOP), 1, 8))
    return catalog.theme_counts(own, "themes", [F.desc("published_date"), F.desc("paper_id")])


def month_segments(spark, sf_dir):
    return catalog.month_segments(spark, "2024-11-17", "2025-03-05")


def topn_per_group(spark, sf_dir):
    return catalog.top_per_group(discoveries(spark, sf_dir), ["source_id", "status"], [F.desc("published_date"), F.col("id")], 2).select("source_id", "status", "id", F.col("position").cast("int").alias("position"))


def carry_over(spark, sf_dir):
    d = discoveries(spark, sf_dir).withColumn("paper_id", F.when(F.col("status") == "acquired", F.concat(F.lit("p"), F.col("id").cast("string")))).withColumn("discovered_at", F.col("published_date"))
    earlier, incoming = d.filter("published_date < '1999-01-01'"), d.filter("published_date >= '1999-01-01'").withColumn("paper_id", F.lit(None).cast("string")).withColumn("status", F.lit("discovered"))
    return upsert.carry_over(incoming, earlier).select("id", "source_id", "status", "paper_id")


# snapshots


def _versions(spark, sf_dir):
    # a second version, acquired later, of the papers that aren't English
    d = table(spark, sf_dir, "documents")
    first = d.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("v1_"), "doc_id").alias("id"), F.lit(1).alias("seq"))
    return first.unionByName(d.filter("lang <> 'en'").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("v2_"), "doc_id").alias("id"), F.lit(2).alias("seq")))


def version_current_flip(spark, sf_dir):
    return upsert.flip_current(_versions(spark, sf_dir), order=[F.desc("seq")]).select("paper_id", "id", "is_current")


def snapshot_members(spark, sf_dir):
    own = papers(spark, sf_dir).withColumnRenamed("paper_id", "id")
    d = discoveries(spark, sf_dir).withColumn("paper_id", F.substring("source_id", 2, 20).cast("long"))
    current = upsert.flip_current(_versions(spark, sf_dir), order=[F.desc("seq")])
    return catalog.snapshot_members(own, current, start="2024-03-01", end="2025-12-31", discoveries=d, category="c1")


def snapshot_coverage(spark, sf_dir):
    return catalog.coverage(discoveries(spark, sf_dir), category="c1", primary_only=False, start="1996-01-01", end="1999-12-31", order=F.desc("id"))


def snapshot_coverage_open(spark, sf_dir):
    """Without a lower bound nothing compares, so that nothing counts."""
    return catalog.coverage(discoveries(spark, sf_dir), category="c1", primary_only=False, start=None, end="1999-12-31", order=F.desc("id"))


# writers


def _stored(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") < 2000, "").otherwise(F.col("c_mktsegment")).alias("abstract"), F.col("c_nationkey").cast("string").alias("date"))


def _incoming(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("title"), F.when(F.col("c_acctbal") > 7000, "").otherwise(F.lower("c_mktsegment")).alias("abstract"), F.when(F.col("c_nationkey") < 4, None).otherwise("2025").alias("date"))


def upsert_keep_nonempty(spark, sf_dir):
    return upsert.keep_nonempty(_stored(spark, sf_dir), _incoming(spark, sf_dir), "id", ["abstract", "date"])


def upsert_last_wins(spark, sf_dir):
    return upsert.last_wins(_stored(spark, sf_dir), _incoming(spark, sf_dir), ["id"])


def insert_or_ignore(spark, sf_dir):
    return upsert.insert_or_ignore(_stored(spark, sf_dir), _incoming(spark, sf_dir), ["id"])


def replace_group(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "session_fingerprint", "label", "confidence")
    return upsert.replace_group(e.drop("confidence"), e.filter("confidence > 0.97").drop("confidence").withColumn("label", F.lit("new")), ["session_fingerprint"])


def cascade_delete(spark, sf_dir):
    e = events(spark, sf_dir)
    return upsert.cascade_delete(e.select("event_id", "session_fingerprint"), e.filter("source = 'codex' AND confidence > 0.95"), ["session_fingerprint"])


# identity and text


def stable_ids(spark, sf_dir):
    own = papers(spark, sf_dir)
    paper = t.stable_id("paper", t.normal_title(F.col("title")))
    return own.select("paper_id", paper.alias("stable_paper"), t.stable_id("version", paper, F.sha2("abstract", 256)).alias("stable_version"))


def title_normalise(spark, sf_dir):
    return papers(spark, sf_dir).select(t.normal_title(F.col("title")).alias("normal")).groupBy("normal").agg(F.count(F.lit(1)).alias("papers"))


def slugify(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", t.slug(F.col("title"), F.col("published_date")).alias("slug"))


def clip_text(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", t.clip(F.col("abstract"), 120).alias("clipped"), t.clean_label(F.col("title")).alias("label"))


def redact_secrets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.redact(F.col("text")).alias("r"))
    return d.select("doc_id", F.sha2("r", 256).alias("digest"), F.contains("r", F.lit("[REDACTED]")).alias("redacted"))


def scholarly_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/2508."), F.lpad(n, 5, "0"), F.lit("v3"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://arxiv.org/pdf/2401."), F.lpad(n, 5, "0"), F.lit("v1.pdf"))).otherwise(F.concat(F.lit("https://doi.org/10.1000%2Fx."), n))
    return p.select("page_id", t.scholarly_id(url).alias("scholarly_id"))


def hash_jitter(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", F.round(t.jitter(F.col("paper_id")), 9).alias("jitter"))


def json_fields(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.max(F.get_json_object("props", "$.k").cast("double")).alias("largest"))


# ranking


def _ranked_input(spark, sf_dir):
    label = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), "quality")
    return papers(spark, sf_dir).join(label, "paper_id", "left").withColumn("similarity", (F.col("paper_id") % 101) / 100.0).withColumn("is_new", F.coalesce(F.col("quality") == 1, F.lit(False))).withColumn("cluster", F.col("source"))


def ranked_groups(spark, sf_dir):
    out = ranking.ranked_groups(_ranked_input(spark, sf_dir), today=TODAY, positive=LIKES, negative=DISLIKES, active=True, groups=["cluster"])
    return out.select("cluster", "paper_id", F.col("position").cast("int").alias("position"), "score", "affinity", "recency", "citation", "reasons")


def ranked_groups_neutral(spark, sf_dir):
    out = ranking.ranked_groups(_ranked_input(spark, sf_dir), today=TODAY, positive=[], negative=[], active=False, groups=["cluster"])
    return out.select("cluster", "paper_id", F.col("position").cast("int").alias("position"), "score")


def citation_percentile(spark, sf_dir):
    return ranking.with_citation_percentile(papers(spark, sf_dir), TODAY, ["lang"]).select("paper_id", ranking.six_places(F.col("citation")).alias("citation"))


# profile and lanes


def profile_weights(spark, sf_dir):
    liked = papers(spark, sf_dir).join(table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi")
    return profile.label_weights(events(spark, sf_dir), liked, F.lit("2024-02-01 00:00:00"))


def profile_concepts(spark, sf_dir):
    return profile.top_concepts(profile.label_weights(events(spark, sf_dir), None, F.lit("2024-02-01 00:00:00")))


def profile_activation(spark, sf_dir):
    return profile.activation(events(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1"))


def _scored(spark, sf_dir):
    return profile.priority_scores(papers(spark, sf_dir).withColumnRenamed("paper_id", "id"), LIKES, TODAY)


def priority_scores(spark, sf_dir):
    return _scored(spark, sf_dir).withColumnRenamed("id", "paper_id")


def priority_lanes(spark, sf_dir):
    scores = staged(_scored(spark, sf_dir), "scores")  # each lane reads them
    return profile.lanes(scores, 40).select(F.col("id").alias("paper_id"), "lane", "final_score")


# parsing


def _pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("Preface line\n\nAbstract\n"), F.substring_index("text", "\n", 1), F.lit("\n\n\n2. Results and more\nFigure "), (F.col("doc_id") % 9).cast("string"), F.lit(": what the numbers show\nand one more line\n"))
    one = d.select(F.col("doc_id").alias("id"), F.lit(1).alias("page"), head.alias("text"))
    return one.unionByName(d.select(F.col("doc_id").alias("id"), F.lit(2).alias("page"), F.concat(F.lit("  carried on \n"), "text").alias("text")))


def section_split(spark, sf_dir):
    return parse.sections(_pages(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), "heading", F.md5("text").alias("digest"), "page_start", "page_end")


def figure_captions(spark, sf_dir):
    return parse.captions(_pages(spark, sf_dir)).select(F.col("id").alias("doc_id"), "page", "label", "caption")


def passage_pack(spark, sf_dir):
    return parse.passages(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "ordinal", F.md5("passage").alias("digest"), F.length("passage").alias("n_chars"))


def figure_range_join(spark, sf_dir):
    figures = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("version"), (F.col("o_custkey") % 40).cast("int").alias("page"), F.col("o_orderkey").cast("string").alias("label"))
    d = table(spark, sf_dir, "documents")
    own = d.select((F.col("doc_id") % 50).alias("version"), F.concat(F.lit("e"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("evidence_id"), (F.col("doc_id") % 37).cast("int").alias("page_start"), (F.col("doc_id") % 37 + F.col("doc_id") % 5).cast("int").alias("page_end"), "text")
    return parse.nearby(figures, own).select("version", "page", "label", F.array_join("nearby_evidence_ids", ",").alias("nearby"))


# history


def user_turns(spark, sf_dir):
    return history.user_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", last=3).select("conv_id", "turn", F.md5("text").alias("digest"), F.col("recent").cast("int").alias("recent"))


def turn_budget(spark, sf_dir):
    return history.within_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", each=150, total=400).select("conv_id", "turn", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def research_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(history.about_research(F.col("text"))).alias("research"))


def stated_interests(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("note", F.concat(F.when(F.col("turn") % 2 == 0, "Avoid ").otherwise("I want "), "text"))
    return history.stated_interests(notes, "note", "conv_id", "turn").select("conv_id", "turn", F.col("nth").cast("int").alias("nth"), "label", "kind")


# evidence


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("4.0"))).otherwise(F.array().cast("array<string>"))
    cites = F.array(F.col("doc_id"), F.when(F.col("doc_id") % 6 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")))
    return d.select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 10).alias("paper_version_id"), F.when(F.col("doc_id") % 13 == 0, " ").otherwise("a claim").alias("statement"), cites.alias("evidence_ids"), number.alias("numeric_values"), (F.col("doc_id") % 30 / 20.0).alias("confidence"))


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), (F.col("doc_id") % 10).alias("paper_version_id"), "text")


def evidence_validation(spark, sf_dir):
    return evidence.valid_records(_records(spark, sf_dir), _passages(spark, sf_dir)).select("record_id", F.size("evidence_ids").alias("cited"), F.round("confidence", 6).alias("confidence"))


def records_with_evidence(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("record_id"), F.col("l_partkey").alias("evidence_id")).distinct()
    return evidence.with_evidence_ids(_records(spark, sf_dir).select("record_id", F.round("confidence", 6).alias("confidence")), links.withColumn("evidence_id", F.col("evidence_id").cast("string")))


def missing_evidence(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("evidence_id"))
    return evidence.missing_ids(asked, _passages(spark, sf_dir), "evidence_id")


def fanout_counts(spark, sf_dir):
    """Records and figures of each paper: each side is counted before the join, so that nothing fans out."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.countDistinct("o_orderkey").alias("records"))
    line = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("paper_id")).agg(F.countDistinct("l_partkey").alias("figures"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    return c.join(o, "paper_id", "left").join(line, "paper_id", "left").select("paper_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("figures", F.lit(0)).alias("figures"))


def session_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("source").agg(F.countDistinct("session_fingerprint").alias("sessions"), F.count("event_id").alias("events"), F.max("observed_at").cast("timestamp_ntz").alias("newest"))


def paper_mean_vectors(spark, sf_dir):
    """Mean of the passage vectors of each paper."""
    each = vectors(spark, sf_dir).select((F.col("vec_id") % 40).alias("paper_id"), F.posexplode("v").alias("dim", "x"))
    return each.groupBy("paper_id", "dim").agg(F.round(F.avg("x"), 6).alias("x"))


QUERIES = {f.__name__: f for f in (canonical_catalog, catalog_filters, group_status_counts, corpus_status, papers_per_day, theme_counts, month_segments, topn_per_group, carry_over, version_current_flip, snapshot_members, snapshot_coverage, snapshot_coverage_open, upsert_keep_nonempty, upsert_last_wins, insert_or_ignore, replace_group, cascade_delete, stable_ids, title_normalise, slugify, clip_text, redact_secrets, scholarly_ids, hash_jitter, json_fields, ranked_groups, ranked_groups_neutral, citation_percentile, profile_weights, profile_concepts, profile_activation, priority_scores, priority_lanes, section_split, figure_captions, passage_pack, figure_range_join, user_turns, turn_budget, research_filter, stated_interests, evidence_validation, records_with_evidence, missing_evidence, fanout_counts, session_counts, paper_mean_vectors)}
