"""Queries: extraction, stored organisation, daily digest; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import digest
from fathomline.plans import extraction, organisation
from fathomline.plans.search import sql_tokens
from fathomline.plans.views import PAPERS, papers, table

TERMS = ["the", "thly", "tion", "ering", "und", "que", "les", "der"]
LABELS = ["Purchase", "click"]


def _counted(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"))
    figures = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("paper_id"))
    return digest.counted(papers(spark, sf_dir), records, figures)


def _scored(spark, sf_dir):
    semantic = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 0.5 + F.col("toxic") - 0.25).cast("double").alias("semantic"))
    return digest.preference_scores(_counted(spark, sf_dir).join(semantic, "paper_id", "left"), TERMS, "semantic")


def digest_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("paper_id", "records", "figures", F.array_join("matches", " ").alias("matches"), "preference")


def digest_candidates(spark, sf_dir):
    return digest.candidates(_scored(spark, sf_dir), 40, True).select("paper_id", "position", "picked")


def digest_candidates_editorial(spark, sf_dir):
    return digest.candidates(_scored(spark, sf_dir), 40, False).select("paper_id", "position", "picked")


def digest_terms(spark, sf_dir):
    """Terms of the papers of one source, as those of a reader's favourites."""
    liked = papers(spark, sf_dir).filter("source = 'src1'").select("title", "abstract", F.array("lang").alias("statements"))
    return digest.profile_terms(liked, LABELS)


def digest_article_errors(spark, sf_dir):
    """Orders as articles: customers are papers, line items passages, of which every article names one of its own and some one of another's."""
    o = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    articles = o.select(
        text(key).alias("article"),
        text(customer).alias("paper_id"),
        F.when(key % 3 == 0, "preference").when(key % 3 == 1, "editorial").otherwise(F.when(key % 5 == 0, "other").otherwise("exploration")).alias("mode"),
        F.repeat(F.lit("why "), (key % 9).cast("int")).alias("reason"),
        F.when(key % 7 == 0, " ").otherwise("title").alias("title"),
        F.lit("dek").alias("dek"),
        F.lit("surprise").alias("surprise"),
        F.concat(F.repeat(F.lit("word "), (key % 40).cast("int")), text(key)).alias("body"),
        F.array("o_orderpriority").alias("themes"),
        F.when(key % 11 == 0, None).when(key % 4 == 0, F.array(text(key), text(key + 1))).otherwise(F.array(text(key))).alias("evidence_ids"),
        F.when(key % 6 == 0, F.array(F.concat(F.lit("f"), text(customer)))).alias("figure_ids"),
        F.when(key % 8 == 0, F.array(text(customer + 700))).alias("related_ids"),
        F.when(key % 3 == 0, F.array(text(key % 50))).alias("matched_favourites"),
        F.when(key % 10 == 0, F.array(F.lit("CLICK"), F.concat(F.lit("label"), text(key % 2)))).alias("matched_labels"),
    )
    customers = table(spark, sf_dir, "customer").select(text(F.col("c_custkey")).alias("paper_id"), F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("source_url"), "c_nationkey")
    return digest.article_errors(
        articles,
        candidates=customers.filter("c_nationkey < 20").select("paper_id"),
        passages=o.select(text(key).alias("id"), text(customer).alias("paper_id")),
        figures=customers.filter("c_nationkey % 2 = 0").select(F.concat(F.lit("f"), "paper_id").alias("id"), "paper_id"),
        papers=customers.select("paper_id", "source_url"),
        favourites=customers.filter("c_nationkey < 12").select("paper_id"),
        labels=LABELS,
        least_words=20,
    )


def pending_extractions(spark, sf_dir):
    versions = table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), "doc_id").alias("paper_version_id"))
    types = spark.createDataFrame([(x,) for x in extraction.TYPES], "record_type string")
    labels = table(spark, sf_dir, "labels")
    done = labels.select(F.concat(F.lit("v"), "doc_id").alias("paper_version_id"), F.when(F.col("quality") == 1, "method").otherwise("limitation").alias("record_type"))
    return extraction.pending(versions, types, done)


def shown_evidence(spark, sf_dir):
    """What a prompt shows of each conversation: turns as passages, at most 3 of 60 characters."""
    c = table(spark, sf_dir, "conversations")
    passages = c.select(F.col("conv_id").cast("string").alias("paper_version_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), F.col("turn").alias("ordinal"), F.col("role").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))
    return extraction.shown_evidence(passages, 3, 60).select("paper_version_id", F.md5("shown").alias("digest"), F.length("shown").alias("n_chars"))


def _members(spark, sf_dir):
    """Customers as papers, their nation as cluster."""
    c = table(spark, sf_dir, "customer")
    return organisation.member_order(c.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("paper_id"), F.col("c_mktsegment").alias("title"), F.round(F.col("c_acctbal").cast("double") / 10000, 1).alias("similarity"), (F.col("c_custkey") % 5 == 0).alias("is_new")))


def organisation_members(spark, sf_dir):
    return _members(spark, sf_dir).select("cluster", "paper_id", "place")


def organisation_heads(spark, sf_dir):
    return organisation.cluster_heads(_members(spark, sf_dir)).select("cluster", "ordinal", "paper_count", "new_count", "average_similarity", "first_title")


QUERIES = {f.__name__: f for f in (digest_scores, digest_candidates, digest_candidates_editorial, digest_terms, digest_article_errors, pending_extractions, shown_evidence, organisation_members, organisation_heads)}

_LIST = "[" + ", ".join(f"'{x}'" for x in sorted(TERMS)) + "]"
_SCORED = f"""{PAPERS},
    r AS (SELECT user_id AS paper_id, count(*) AS records FROM events GROUP BY ALL), f AS (SELECT o_custkey * 3 AS paper_id, count(*) AS figures FROM orders GROUP BY ALL),
    s AS (SELECT doc_id AS paper_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(quality * 0.5 + toxic - 0.25 AS DOUBLE))) AS near FROM labels),
    k AS (SELECT paper_id, published_date, coalesce(records, 0) AS records, coalesce(figures, 0) AS figures, near, {sql_tokens("title || ' ' || coalesce(abstract, '')", 'DIGEST_STOP')} AS own
          FROM papers LEFT JOIN r USING (paper_id) LEFT JOIN f USING (paper_id) LEFT JOIN s USING (paper_id)),
    m AS (SELECT *, list_filter({_LIST}, lambda x: list_contains(own, x)) AS common FROM k),
    l AS (SELECT *, round(len(common) / greatest(1.0::DOUBLE, sqrt({len(TERMS)}::DOUBLE) * sqrt(len(own)::DOUBLE)), 4) AS lexical FROM m),
    scored AS (SELECT *, round(coalesce(0.8::DOUBLE * near + 0.2::DOUBLE * lexical, lexical), 4) AS preference FROM l)"""
_EDITORIAL = "records DESC, figures DESC, published_date DESC, paper_id"
_NO = "[]::VARCHAR[]"

ORACLE_SQL = {
    "digest_scores": f"WITH {_SCORED} SELECT paper_id, records, figures, array_to_string(list_slice(common, 1, 8), ' ') AS matches, preference FROM scored",
    "digest_candidates": f"""
        WITH {_SCORED}, best AS (SELECT paper_id, row_number() OVER (ORDER BY preference DESC, records DESC, figures DESC, paper_id) AS position, 'preference' AS picked FROM scored QUALIFY position <= 24),
        rest AS (SELECT paper_id, 24 + row_number() OVER (ORDER BY {_EDITORIAL}) AS position, 'editorial' AS picked FROM scored WHERE paper_id NOT IN (SELECT paper_id FROM best) QUALIFY position <= 40)
        SELECT paper_id, CAST(position AS INTEGER) AS position, picked FROM (FROM best UNION ALL FROM rest)""",
    "digest_candidates_editorial": f"WITH {_SCORED} SELECT paper_id, CAST(row_number() OVER (ORDER BY {_EDITORIAL}) AS INTEGER) AS position, 'editorial' AS picked FROM scored QUALIFY position <= 40",
    "digest_terms": f"""
        WITH {PAPERS}, x AS (SELECT unnest({sql_tokens("title || ' ' || coalesce(abstract, '') || ' ' || lang", 'DIGEST_STOP')}) AS term, 1 AS n FROM papers WHERE source = 'src1'
        UNION ALL SELECT unnest(['purchase', 'click']), 2) SELECT term, CAST(sum(n) AS BIGINT) AS weight FROM x GROUP BY term ORDER BY weight DESC, term LIMIT 30""",
    "digest_article_errors": f"""
        WITH a AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS article, CAST(o_custkey AS VARCHAR) AS paper_id,
            CASE WHEN o_orderkey % 3 = 0 THEN 'preference' WHEN o_orderkey % 3 = 1 THEN 'editorial' WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'exploration' END AS mode,
            CASE WHEN o_orderkey % 11 = 0 THEN {_NO} WHEN o_orderkey % 4 = 0 THEN [CAST(o_orderkey AS VARCHAR), CAST(o_orderkey + 1 AS VARCHAR)] ELSE [CAST(o_orderkey AS VARCHAR)] END AS ev,
            CASE WHEN o_orderkey % 6 = 0 THEN ['f' || o_custkey] ELSE {_NO} END AS fig,
            CASE WHEN o_orderkey % 8 = 0 THEN [CAST(o_custkey + 700 AS VARCHAR)] ELSE {_NO} END AS rel,
            CASE WHEN o_orderkey % 3 = 0 THEN [CAST(o_orderkey % 50 AS VARCHAR)] ELSE {_NO} END AS fav,
            CASE WHEN o_orderkey % 10 = 0 THEN ['click', 'label' || (o_orderkey % 2)] ELSE {_NO} END AS lab,
            count(*) OVER (PARTITION BY o_custkey) AS times FROM orders),
        c AS (SELECT CAST(c_custkey AS VARCHAR) AS paper_id, c_nationkey AS n FROM customer),
        e AS (SELECT article, unnest(ev) AS id, paper_id FROM a), bad_e AS (SELECT DISTINCT e.article FROM e WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.article = e.id AND x.paper_id = e.paper_id)),
        r(article, error) AS (
            SELECT article, 'not a candidate' FROM a LEFT JOIN c USING (paper_id) WHERE n IS NULL OR n >= 20
            UNION ALL SELECT article, 'paper repeated' FROM a WHERE times > 1
            UNION ALL SELECT article, 'no evidence' FROM a WHERE len(ev) = 0
            UNION ALL SELECT article, 'evidence of another paper' FROM bad_e
            UNION ALL SELECT article, 'figure of another paper' FROM a LEFT JOIN c USING (paper_id) WHERE len(fig) > 0 AND (n IS NULL OR n % 2 = 1)
            UNION ALL SELECT article, 'figures left out' FROM a JOIN c USING (paper_id) WHERE n % 2 = 0 AND len(fig) = 0
            UNION ALL SELECT article, 'too short' FROM a WHERE k % 40 + 1 < 20
            UNION ALL SELECT article, 'evidence not inline' FROM a WHERE EXISTS (SELECT 1 FROM e WHERE e.article = a.article AND NOT contains(a.article, e.id))
            UNION ALL SELECT article, 'figure not inline' FROM a WHERE len(fig) > 0
            UNION ALL SELECT article, 'unknown related paper' FROM a WHERE len(rel) > 0 AND rel[1] NOT IN (SELECT paper_id FROM c)
            UNION ALL SELECT article, 'unknown mode' FROM a WHERE mode = 'other'
            UNION ALL SELECT article, 'reason too short' FROM a WHERE length(trim(repeat('why ', CAST(k % 9 AS INTEGER)))) < 20
            UNION ALL SELECT article, 'unknown favourite' FROM a WHERE len(fav) > 0 AND fav[1] NOT IN (SELECT paper_id FROM c WHERE n < 12)
            UNION ALL SELECT article, 'unknown label' FROM a WHERE len(lab) > 0
            UNION ALL SELECT article, 'preference without a match' FROM a WHERE mode = 'preference' AND len(fav) = 0 AND len(lab) = 0
            UNION ALL SELECT article, 'match without preference' FROM a WHERE mode <> 'preference' AND (len(fav) > 0 OR len(lab) > 0)
            UNION ALL SELECT article, 'editorial fields missing' FROM a WHERE k % 7 = 0
            UNION ALL SELECT article, 'no source address' FROM a LEFT JOIN c USING (paper_id) WHERE n IS NULL OR n = 3)
        SELECT article, error FROM r""",
    "pending_extractions": f"""
        SELECT 'v' || doc_id AS paper_version_id, record_type FROM (SELECT doc_id, unnest({list(extraction.TYPES)}) AS record_type FROM documents) d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND record_type = CASE WHEN l.quality = 1 THEN 'method' ELSE 'limitation' END)""",
    "shown_evidence": """
        WITH p AS (SELECT conv_id, turn, '[' || conv_id || '-' || turn || '] SECTION=' || coalesce(role, '') || chr(10) || substring(coalesce(text, ''), 1, 60) AS line,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn) AS n FROM conversations),
        s AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS shown FROM p WHERE n <= 3 GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS paper_version_id, md5(shown) AS digest, CAST(length(shown) AS INTEGER) AS n_chars FROM s""",
    "organisation_members": """
        SELECT c_nationkey AS cluster, c_custkey AS paper_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 5 = 0 DESC, round(CAST(c_acctbal AS DOUBLE) / 10000, 1) DESC, c_mktsegment, c_custkey) AS INTEGER) AS place FROM customer""",
    "organisation_heads": """
        WITH m AS (SELECT c_nationkey AS cluster, c_custkey AS paper_id, c_mktsegment AS title, round(CAST(c_acctbal AS DOUBLE) / 10000, 1) AS s, c_custkey % 5 = 0 AS fresh FROM customer),
        p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY fresh DESC, s DESC, title, paper_id) AS place FROM m),
        h AS (SELECT cluster, count(*) AS n, count(*) FILTER (fresh) AS k, round(avg(s), 6) AS a, min(title) FILTER (place = 1) AS first_title, list(paper_id ORDER BY paper_id) AS ids FROM p GROUP BY cluster)
        SELECT cluster, CAST(row_number() OVER (ORDER BY n DESC, ids) - 1 AS INTEGER) AS ordinal, CAST(n AS INTEGER) AS paper_count, CAST(k AS INTEGER) AS new_count, a AS average_similarity, first_title FROM h""",
}
