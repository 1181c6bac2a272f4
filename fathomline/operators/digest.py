"""Daily digest: candidate papers, the terms a reader's favourites share, and the rules that articles must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import DIGEST_STOP, squeeze, token_set

MODES = ("preference", "exploration", "editorial")
ARTICLE = "article string, paper_id string, mode string, reason string, title string, dek string, surprise string, body string, themes array<string>, evidence_ids array<string>, figure_ids array<string>, related_ids array<string>, matched_favourites array<string>, matched_labels array<string>"


def counted(papers: DataFrame, records: DataFrame, figures: DataFrame) -> DataFrame:
    """``papers`` with the numbers of their records and figures; both sides are aggregated before they meet, so that nothing fans out."""
    n_records = records.groupBy("paper_id").agg(F.count(F.lit(1)).alias("records"))
    n_figures = figures.groupBy("paper_id").agg(F.count(F.lit(1)).alias("figures"))
    return papers.join(n_records, "paper_id", "left").join(n_figures, "paper_id", "left").fillna(0, ["records", "figures"])


def preference_scores(papers: DataFrame, terms: list[str], semantic: str | None = None) -> DataFrame:
    """Adds matches (at most 8, in order) and preference (4 places): the overlap with the profile's terms, of which similarity makes up four fifths where ``semantic`` has one."""
    profile = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    own = token_set(F.concat_ws(" ", "title", "abstract"), DIGEST_STOP)
    both = F.array_intersect(profile, own)
    lexical = F.round(F.size(both) / F.greatest(F.lit(1.0), F.sqrt(F.size(profile).cast("double")) * F.sqrt(F.size(own).cast("double"))), 4) if terms else F.lit(0.0)
    # greatest() passes over nulls, and a paper without a vector has no similarity rather than none in common
    near = F.when(F.col(semantic).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(semantic)))) if semantic else F.lit(None).cast("double")
    return papers.withColumn("matches", F.slice(F.array_sort(both), 1, 8)).withColumn("preference", F.round(F.coalesce(0.8 * near + 0.2 * lexical, lexical), 4))


def candidates(scored: DataFrame, limit: int, active: bool) -> DataFrame:
    """(paper_id, position, picked) of the ``limit`` papers an analyst may choose from: with an active profile three fifths of the places go to the best matches,
    the rest by records, figures and date."""
    slots = max(1, round(limit * 0.6)) if active else 0
    narrow = scored.select("paper_id", "records", "figures", "preference", F.coalesce("published_date", F.lit("0000-00-00")).alias("day"))
    best = narrow.orderBy(F.desc("preference"), F.desc("records"), F.desc("figures"), "paper_id").limit(slots).withColumn("picked", F.lit("preference"))
    # of the editorial order, at most ``slots`` papers are taken already
    rest = narrow.orderBy(F.desc("records"), F.desc("figures"), F.desc("day"), "paper_id").limit(limit + slots).join(best.select("paper_id"), "paper_id", "left_anti").withColumn("picked", F.lit("editorial"))
    liked = F.col("picked") == "preference"
    order = Window.orderBy(F.desc(liked), F.when(liked, F.col("preference")).desc(), F.desc("records"), F.desc("figures"), F.when(~liked, F.col("day")).desc(), "paper_id")
    # a window over a few dozen rows
    return best.unionByName(rest).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("paper_id", "position", "picked")


def profile_terms(favourites: DataFrame, labels: list[str], most: int = 30) -> DataFrame:
    """(term, weight): papers among favourites(title, abstract, statements) that have the term, twice as much for a stated label."""
    mine = favourites.select(F.explode(token_set(F.concat_ws(" ", "title", "abstract", F.concat_ws(" ", "statements")), DIGEST_STOP)).alias("term"), F.lit(1).alias("n"))
    said = favourites.sparkSession.createDataFrame([(x,) for x in labels], "label string").select(F.explode(token_set(F.col("label"), DIGEST_STOP)).alias("term"), F.lit(2).alias("n"))
    return mine.unionByName(said).groupBy("term").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "term").limit(most)


def _strangers(articles: DataFrame, ids: str, owned: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Articles that name an id which ``owned`` lacks."""
    each = articles.select("article", "paper_id", F.explode(F.array_distinct(ids)).alias("id"))
    return each.join(owned.select(*keys), keys, "left_anti").select("article").distinct().withColumn(flag, F.lit(True))


def article_errors(articles: DataFrame, *, candidates: DataFrame, passages: DataFrame, figures: DataFrame, papers: DataFrame, favourites: DataFrame, labels: list[str], least_words: int = 700) -> DataFrame:
    """(article, error), one row for each broken rule of ``articles`` (the columns of ARTICLE).

    candidates(paper_id), passages(id, paper_id), figures(id, paper_id), papers(paper_id, source_url), favourites(paper_id). Sets are checked by
    anti-joins, what stands in the article itself by one pass over it; null lists count as empty."""
    lists = ["evidence_ids", "figure_ids", "related_ids", "matched_favourites", "matched_labels", "themes"]
    held = articles.withColumns({c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in lists})
    known = F.array(*[F.lit(x.lower()) for x in labels]) if labels else F.array().cast("array<string>")
    repeated = held.groupBy("paper_id").agg(F.count(F.lit(1)).alias("times"))
    flags = [
        _strangers(held, "evidence_ids", passages, ["id", "paper_id"], "f_evidence"),
        _strangers(held, "figure_ids", figures, ["id", "paper_id"], "f_figure"),
        _strangers(held, "related_ids", papers.select(F.col("paper_id").alias("id")), ["id"], "f_related"),
        _strangers(held, "matched_favourites", favourites.select(F.col("paper_id").alias("id")), ["id"], "f_favourite"),
    ]
    for flag in flags:
        held = held.join(flag, "article", "left")
    held = held.join(repeated, "paper_id", "left").join(candidates.select("paper_id", F.lit(True).alias("candidate")).distinct(), "paper_id", "left")
    held = held.join(figures.groupBy("paper_id").agg(F.lit(True).alias("has_figures")), "paper_id", "left").join(papers.select("paper_id", F.col("source_url").alias("url")), "paper_id", "left")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    body, mode = text("body"), F.coalesce("mode", F.lit(""))
    inline = lambda ids: F.forall(ids, lambda x: F.contains(body, x))
    matched = (F.size("matched_favourites") > 0) | (F.size("matched_labels") > 0)
    rules = {
        "not a candidate": F.col("candidate").isNull(),
        "paper repeated": F.coalesce("times", F.lit(1)) > 1,
        "no evidence": F.size("evidence_ids") == 0,
        "evidence of another paper": F.col("f_evidence"),
        "figure of another paper": F.col("f_figure"),
        "figures left out": F.col("has_figures") & (F.size("figure_ids") == 0),
        "too short": F.size(F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0))) < least_words,
        "evidence not inline": ~inline("evidence_ids"),
        "figure not inline": ~inline("figure_ids"),
        "unknown related paper": F.col("f_related"),
        "unknown mode": ~mode.isin(*MODES),
        "reason too short": F.length(squeeze(F.coalesce("reason", F.lit("")))) < 20,
        "unknown favourite": F.col("f_favourite"),
        "unknown label": ~F.forall("matched_labels", lambda x: F.array_contains(known, F.lower(x))),
        "preference without a match": (mode == "preference") & ~matched,
        "match without preference": (mode != "preference") & matched,
        "editorial fields missing": (text("title") == "") | (text("dek") == "") | (text("surprise") == "") | (F.size("themes") == 0),
        "no source address": F.coalesce("url", F.lit("")) == "",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return held.select("article", F.explode(found).alias("error"))
