"""SQL of the relational queries."""

from fathomline.functions import text as t
from fathomline.plans.relational import CATEGORY, DISLIKES, LIKES
from fathomline.plans.search import sql_tokens
from fathomline.plans.views import DISCOVERIES, EVENTS, PAPERS, TODAY

_VERSIONS = "ver AS (SELECT doc_id AS paper_id, 'v1_' || doc_id AS id, 1 AS seq FROM documents UNION ALL SELECT doc_id, 'v2_' || doc_id, 2 FROM documents WHERE lang <> 'en')"
_CURRENT = "cur AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1 AS is_current FROM ver)"
_STORED = "old AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_acctbal < 2000 THEN '' ELSE c_mktsegment END AS abstract, CAST(c_nationkey AS VARCHAR) AS date FROM customer WHERE c_mktsegment <> 'MACHINERY')"
_INCOMING = "inc AS (SELECT c_custkey AS id, lower(c_name) AS title, CASE WHEN c_acctbal > 7000 THEN '' ELSE lower(c_mktsegment) END AS abstract, CASE WHEN c_nationkey < 4 THEN NULL ELSE '2025' END AS date FROM customer WHERE c_nationkey < 12)"
_NORMAL = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_PAGES = r"""pages_ AS (
    SELECT doc_id AS id, 1 AS page, 'Preface line' || chr(10) || chr(10) || 'Abstract' || chr(10) || split_part(text, chr(10), 1) || chr(10) || chr(10) || chr(10) || '2. Results and more' || chr(10) || 'Figure ' || (doc_id % 9) || ': what the numbers show' || chr(10) || 'and one more line' || chr(10) AS text FROM documents
    UNION ALL SELECT doc_id, 2, '  carried on ' || chr(10) || text FROM documents),
    lines_ AS (SELECT id, page, unnest(range(0, len(l))) AS pos, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS line FROM (SELECT id, page, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM pages_))"""
_HEADING = r"(?i)(\d+(\.\d+)*[.)]?\s+)?(abstract|introduction|background|related work|method(ology)?|approach|experiments?|results?|discussion|limitations?|conclusion|future work|references|appendix)(\s.*)?"


def _quoted(items):
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _overlap(k, terms):
    return f"(len(list_filter({k}, lambda x: list_contains({_quoted(terms)}, x))) / greatest(1.0, sqrt(CAST(len({k}) * {len(terms)} AS DOUBLE))))"


def _percentile(groups):
    """citation: CTE p_ (with age, cohort) over ``src``."""
    return f"""
    aged AS (SELECT *, greatest(0, date_diff('day', CAST(published_date AS DATE), DATE '{TODAY}')) AS age FROM src),
    coh AS (SELECT *, CASE WHEN citation_count IS NULL OR age < 14 THEN NULL WHEN age < 30 THEN '30' WHEN age < 90 THEN '90' WHEN age < 365 THEN '365' ELSE 'old' END AS cohort, ln(1 + greatest(0, citation_count)) AS lg FROM aged),
    per AS (SELECT *, CASE WHEN citation_count IS NULL THEN NULL WHEN age < 14 THEN 0.5 WHEN count(*) OVER (PARTITION BY {groups}, cohort) = 1 THEN 0.5
            ELSE (rank() OVER (PARTITION BY {groups}, cohort ORDER BY lg) - 1 + (count(*) OVER (PARTITION BY {groups}, cohort, lg) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY {groups}, cohort) - 1) END AS citation FROM coh)"""


_SRC = "src AS (SELECT p.*, (paper_id % 101) / 100.0::DOUBLE AS similarity, coalesce(l.quality = 1, FALSE) AS is_new, p.source AS cluster FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id)"
_RECENCY = "pow(2.0::DOUBLE, -age / 180.0::DOUBLE)"

_WEIGHTS = f"""
    parts AS (
        SELECT lower(label) AS key, label, observed_at, CASE WHEN kind = 'negative' THEN 0.0 ELSE v END AS plus, CASE WHEN kind = 'negative' THEN v ELSE 0.0 END AS minus, source = 'dashboard_explicit' AS stated
        FROM (SELECT *, confidence * CASE WHEN source = 'dashboard_explicit' THEN 2.5 WHEN explicitness = 'explicit' THEN 1.0 ELSE 0.65 END
              * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(observed_at)) / 86400e6) / 180.0) AS v FROM pref)"""
_NET = """
    g AS (SELECT key, arg_min(label, (coalesce(observed_at, TIMESTAMP '9999-01-01'), label)) AS label, greatest(-3.0::DOUBLE, least(6.0::DOUBLE, CAST(sum(plus) AS DOUBLE) - CAST(sum(minus) AS DOUBLE))) AS net, bool_or(stated) AS stated FROM parts GROUP BY key),
    w AS (SELECT label, round(net, 4) AS weight, CASE WHEN net < 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN stated THEN 'explicit' ELSE 'learned' END AS source FROM g WHERE abs(net) >= 0.15)"""

_PRIORITY = f"""
    tok AS (SELECT *, {sql_tokens("title || chr(10) || abstract", 'PROFILE_STOP')} AS k, greatest(0, date_diff('day', CAST(published_date AS DATE), DATE '{TODAY}')) AS age FROM papers),
    ex AS (SELECT paper_id, unnest(k) AS token FROM tok), df AS (SELECT token, count(*) AS df FROM ex GROUP BY token),
    sg AS (SELECT paper_id, CAST(sum(CASE WHEN df > 1 THEN df ELSE 0 END) AS DOUBLE) AS topical, sum(1.0::DOUBLE / df) AS rare FROM ex JOIN df USING (token) GROUP BY paper_id),
    rw AS (SELECT *, CASE WHEN citation_count IS NULL THEN NULL WHEN age >= 14 THEN ln(1 + citation_count) / sqrt(CAST(greatest(30, age) AS DOUBLE)) ELSE 0.5 END AS raw FROM tok),
    pc AS (SELECT *, CASE WHEN raw IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY raw IS NULL ORDER BY raw) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY raw)) / count(raw) OVER () END AS citation FROM rw),
    sc AS (SELECT pc.*, {_overlap('k', LIKES)} AS a, {_RECENCY} AS r, coalesce(citation, 0.5) AS neutral, greatest(1, len(k)) AS n, topical, rare FROM pc LEFT JOIN sg USING (paper_id)),
    pr AS (SELECT paper_id, round(a, 6) AS affinity, round(0.60::DOUBLE * a + 0.25::DOUBLE * r + 0.15::DOUBLE * neutral, 6) AS relevance,
           round(0.35::DOUBLE * least(1.0::DOUBLE, coalesce(topical, 0) / n / 4.0::DOUBLE) + 0.25::DOUBLE * coalesce(rare, 0) / n + 0.15::DOUBLE * least(1.0::DOUBLE, length(abstract) / 1200.0::DOUBLE) + 0.15::DOUBLE * r + 0.10::DOUBLE * neutral, 6) AS frontier,
           round((1.0::DOUBLE - a) * (0.8::DOUBLE + 0.2::DOUBLE * (('0x' || substr(sha256(CAST(paper_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE)), 6) AS exploration, round(citation, 6) AS citation FROM sc)"""


def _lane(name, order, count, before):
    rest = " AND ".join(f"paper_id NOT IN (SELECT paper_id FROM {b})" for b in before) or "TRUE"
    return f"{name} AS (SELECT paper_id, '{name[2:]}' AS lane FROM pr WHERE {rest} ORDER BY {order} DESC, paper_id LIMIT {count})"


_INTEREST = r"list_slice(list_filter(list_transform(regexp_split_to_array(note, '[\n.;]+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), 1, 12)"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _redacted(column):
    for pattern in t.SECRETS:
        column = f"regexp_replace({column}, '{pattern}', '[REDACTED]', 'g')"
    return column


_RECORDS = """rec AS (SELECT doc_id AS record_id, doc_id % 10 AS ver, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'a claim' END AS statement, list_distinct([doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id + 1 ELSE doc_id END]) AS ev, doc_id % 4 = 0 AS num, doc_id % 30 / 20.0::DOUBLE AS confidence FROM documents)"""

ORACLE_SQL = {
    "canonical_catalog": f"WITH {DISCOVERIES} SELECT source_id, id, status, published_date FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE status WHEN 'acquired' THEN 0 ELSE 1 END, published_date DESC, id DESC) AS n FROM disc) WHERE n = 1",
    "catalog_filters": f"WITH {DISCOVERIES} SELECT primary_category, status, count(*) AS n, min(published_date) AS first_date FROM disc WHERE (primary_category = 'c1' OR list_contains(categories, 'c1')) AND published_date >= '1996-01-01' AND published_date <= '1998-06-30' GROUP BY ALL",
    "group_status_counts": f"""WITH {DISCOVERIES}, c AS (SELECT group_id, count(*) AS discovered, count(*) FILTER (status = 'acquired') AS acquired, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (primary_category = '{CATEGORY}') AS primary_total,
        count(*) FILTER (primary_category = '{CATEGORY}' AND status = 'acquired') AS primary_acquired, count(*) FILTER (primary_category = '{CATEGORY}' AND status = 'failed') AS primary_failed FROM disc GROUP BY group_id)
        SELECT *, primary_total - primary_acquired - primary_failed AS primary_pending FROM c""",
    "corpus_status": f"WITH {DISCOVERIES} SELECT (SELECT count(DISTINCT source_id) FROM disc) AS catalog_papers, (SELECT count(*) FROM documents) AS full_text_papers, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM labels) AS records, (SELECT count(*) FROM conversations) AS turns",
    "papers_per_day": f"WITH {DISCOVERIES} SELECT published_date AS day, count(*) AS papers FROM disc GROUP BY day ORDER BY day DESC LIMIT 30",
    "theme_counts": f"WITH {PAPERS}, n AS (SELECT * FROM papers ORDER BY published_date DESC, paper_id DESC LIMIT 30) SELECT theme, count(*) AS n FROM (SELECT unnest(list_slice({sql_tokens('title', 'PROFILE_STOP', ordered=True)}, 1, 8)) AS theme FROM n) GROUP BY theme ORDER BY n DESC, theme LIMIT 12",
    "month_segments": "SELECT CAST(greatest(m, DATE '2024-11-17') AS DATE) AS segment_start, CAST(least(last_day(m), DATE '2025-03-05') AS DATE) AS segment_end FROM (SELECT CAST(unnest(generate_series(DATE '2024-11-01', DATE '2025-03-05', INTERVAL 1 MONTH)) AS DATE) AS m)",
    "topn_per_group": f"WITH {DISCOVERIES} SELECT source_id, status, id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY source_id, status ORDER BY published_date DESC, id) AS position FROM disc) WHERE position <= 2",
    "carry_over": f"""WITH {DISCOVERIES}, e AS (SELECT source_id, max((published_date, 'p' || id)) AS m FROM disc WHERE published_date < '1999-01-01' AND status = 'acquired' GROUP BY source_id)
        SELECT d.id, d.source_id, CASE WHEN e.m IS NULL THEN 'discovered' ELSE 'acquired' END AS status, e.m[2] AS paper_id FROM disc d LEFT JOIN e USING (source_id) WHERE d.published_date >= '1999-01-01'""",
    "version_current_flip": f"WITH {_VERSIONS}, {_CURRENT} SELECT paper_id, id, is_current FROM cur",
    "snapshot_members": f"""WITH {PAPERS}, {DISCOVERIES}, {_VERSIONS}, {_CURRENT} SELECT p.paper_id, c.id AS paper_version_id FROM papers p JOIN cur c ON c.paper_id = p.paper_id AND c.is_current
        WHERE p.source_class <> 'synthetic' AND p.published_date >= '2024-03-01' AND p.published_date <= '2025-12-31' AND EXISTS (SELECT 1 FROM disc d WHERE CAST(substr(d.source_id, 2) AS BIGINT) = p.paper_id AND (d.primary_category = 'c1' OR list_contains(d.categories, 'c1')))""",
    "snapshot_coverage": f"""WITH {DISCOVERIES}, r AS (SELECT status, row_number() OVER (PARTITION BY source_id ORDER BY CASE status WHEN 'acquired' THEN 0 ELSE 1 END, id DESC) AS n FROM disc WHERE published_date >= '1996-01-01' AND published_date <= '1999-12-31' AND (primary_category = 'c1' OR list_contains(categories, 'c1')))
        SELECT count(*) AS catalog_papers, count(*) FILTER (status = 'acquired') AS full_text_papers, count(*) FILTER (status = 'failed') AS unavailable_papers FROM r WHERE n = 1""",
    "snapshot_coverage_open": f"WITH {DISCOVERIES} SELECT count(*) AS catalog_papers, count(*) FILTER (status = 'acquired') AS full_text_papers, count(*) FILTER (status = 'failed') AS unavailable_papers FROM disc WHERE published_date >= NULL",
    "upsert_keep_nonempty": f"""WITH {_STORED}, {_INCOMING} SELECT coalesce(old.id, inc.id) AS id, CASE WHEN old.id IS NULL THEN inc.title ELSE old.title END AS title,
        CASE WHEN old.id IS NULL OR inc.abstract <> '' THEN inc.abstract ELSE old.abstract END AS abstract, CASE WHEN old.id IS NULL OR inc.date <> '' THEN inc.date ELSE old.date END AS date FROM old FULL JOIN inc ON old.id = inc.id""",
    "upsert_last_wins": f"WITH {_STORED}, {_INCOMING} SELECT * FROM inc UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM inc)",
    "insert_or_ignore": f"WITH {_STORED}, {_INCOMING} SELECT * FROM old UNION ALL SELECT * FROM inc WHERE id NOT IN (SELECT id FROM old)",
    "replace_group": f"WITH {EVENTS} SELECT event_id, session_fingerprint, label FROM pref WHERE session_fingerprint NOT IN (SELECT session_fingerprint FROM pref WHERE confidence > 0.97) UNION ALL SELECT event_id, session_fingerprint, 'new' FROM pref WHERE confidence > 0.97",
    "cascade_delete": f"WITH {EVENTS} SELECT event_id, session_fingerprint FROM pref WHERE session_fingerprint NOT IN (SELECT session_fingerprint FROM pref WHERE source = 'codex' AND confidence > 0.95)",
    "stable_ids": f"WITH {PAPERS}, s AS (SELECT paper_id, abstract, 'paper_' || substr(sha256({_NORMAL}), 1, 20) AS sp FROM papers) SELECT paper_id, sp AS stable_paper, 'version_' || substr(sha256(sp || chr(31) || sha256(abstract)), 1, 20) AS stable_version FROM s",
    "title_normalise": f"WITH {PAPERS} SELECT {_NORMAL} AS normal, count(*) AS papers FROM papers GROUP BY normal",
    "slugify": f"WITH {PAPERS} SELECT paper_id, published_date || '-' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM papers",
    "clip_text": f"WITH {PAPERS}, s AS (SELECT paper_id, {_SQUEEZE.format('abstract')} AS a, {_SQUEEZE.format('title')} AS t FROM papers) SELECT paper_id, CASE WHEN length(a) <= 120 THEN a ELSE rtrim(substr(a, 1, 119)) || '…' END AS clipped, regexp_replace(substr(t, 1, 120), '^[ .,:;-]+|[ .,:;-]+$', '', 'g') AS label FROM s",
    "redact_secrets": f"WITH r AS (SELECT doc_id, {_redacted('text')} AS r FROM documents) SELECT doc_id, sha256(r) AS digest, contains(r, '[REDACTED]') AS redacted FROM r",
    "scholarly_ids": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ARXIV:2508.' || lpad(CAST(page_id AS VARCHAR), 5, '0') WHEN 1 THEN 'ARXIV:2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') ELSE 'DOI:10.1000/x.' || page_id END AS scholarly_id FROM pages",
    "hash_jitter": f"WITH {PAPERS} SELECT paper_id, round(('0x' || substr(sha256(CAST(paper_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS jitter FROM papers",
    "json_fields": f"WITH {EVENTS} SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS largest FROM pref GROUP BY event_type",
    "ranked_groups": f"""WITH {PAPERS}, {_SRC}, {_percentile('cluster')},
        k AS (SELECT *, {sql_tokens("title || ' ' || abstract", 'RANKING_STOP')} AS tk, {_RECENCY} AS rec FROM per),
        a AS (SELECT *, CASE WHEN len(tk) = 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_overlap('tk', LIKES)} * 3.0 - {_overlap('tk', DISLIKES)} * 2.0)) END AS aff FROM k),
        s AS (SELECT *, round((0.30::DOUBLE * similarity + 0.30::DOUBLE * aff + 0.25::DOUBLE * rec + CASE WHEN citation IS NULL THEN 0.0 ELSE 0.15::DOUBLE * citation END) / (0.30::DOUBLE + 0.30::DOUBLE + 0.25::DOUBLE + CASE WHEN citation IS NULL THEN 0.0 ELSE 0.15::DOUBLE END), 6) AS score,
              list_slice(list_sort(list_filter([CASE WHEN aff >= 0.25 THEN {{'s': -aff, 'l': 'Strong match to your interests'}} END, CASE WHEN is_new OR rec >= 0.9 THEN {{'s': -rec, 'l': 'New this month'}} END, CASE WHEN citation >= 0.75 THEN {{'s': -citation, 'l': 'Highly cited for its age'}} END, CASE WHEN similarity >= 0.7 THEN {{'s': -similarity, 'l': 'Central to this neighborhood'}} END], lambda x: x IS NOT NULL)), 1, 2) AS rs FROM a)
        SELECT cluster, paper_id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, published_date DESC, similarity DESC, lower(title), CAST(paper_id AS VARCHAR)) AS INTEGER) AS position, score, round(aff, 6) AS affinity, round(rec, 6) AS recency, round(citation, 6) AS citation, coalesce(array_to_string(list_transform(rs, lambda x: x.l), '; '), '') AS reasons FROM s""",
    "ranked_groups_neutral": f"""WITH {PAPERS}, {_SRC}, {_percentile('cluster')},
        s AS (SELECT *, round((0.50::DOUBLE * similarity + 0.35::DOUBLE * {_RECENCY} + CASE WHEN citation IS NULL THEN 0.0 ELSE 0.15::DOUBLE * citation END) / (0.50::DOUBLE + 0.35::DOUBLE + CASE WHEN citation IS NULL THEN 0.0 ELSE 0.15::DOUBLE END), 6) AS score FROM per)
        SELECT cluster, paper_id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, published_date DESC, similarity DESC, lower(title), CAST(paper_id AS VARCHAR)) AS INTEGER) AS position, score FROM s""",
    "citation_percentile": f"WITH {PAPERS}, src AS (SELECT * FROM papers), {_percentile('lang')} SELECT paper_id, round(citation, 6) AS citation FROM per",
    "profile_weights": f"""WITH {PAPERS}, {EVENTS}, {_WEIGHTS}
        UNION ALL SELECT unnest(k) AS key, unnest(k) AS label, NULL, 1.5, 0.0, FALSE FROM (SELECT {sql_tokens("title || ' ' || abstract", 'PROFILE_STOP')} AS k FROM papers WHERE paper_id IN (SELECT doc_id FROM labels WHERE quality = 1))), {_NET} SELECT * FROM w""",
    "profile_concepts": f"""WITH {EVENTS}, {_WEIGHTS}), {_NET},
        o AS (SELECT *, row_number() OVER (ORDER BY source <> 'explicit', abs(weight) DESC, lower(label)) AS p, row_number() OVER (PARTITION BY polarity ORDER BY source <> 'explicit', abs(weight) DESC, lower(label)) AS q FROM w)
        SELECT label, weight, polarity, source, p <= 30 AS concept, CASE polarity WHEN 'positive' THEN q <= 24 ELSE q <= 12 END AS kept FROM o WHERE p <= 30 OR CASE polarity WHEN 'positive' THEN q <= 24 ELSE q <= 12 END""",
    "profile_activation": f"""WITH {EVENTS}, c AS (SELECT count(*) AS event_count, count(DISTINCT session_fingerprint) AS session_count, count(*) FILTER (explicitness = 'explicit' AND kind <> 'negative') AS explicit_event_count, (SELECT count(*) FROM labels WHERE quality = 1) AS favorite_count FROM pref)
        SELECT *, event_count > 0 OR favorite_count > 0 AS active, favorite_count >= 3 OR (event_count >= 8 AND session_count >= 3 AND explicit_event_count >= 1) AS active_for_ingestion FROM c""",
    "priority_scores": f"WITH {PAPERS}, {_PRIORITY} SELECT * FROM pr",
    "priority_lanes": f"""WITH {PAPERS}, {_PRIORITY}, {_lane('l_preference', 'relevance', 24, [])}, {_lane('l_frontier', 'frontier', 8, ['l_preference'])}, {_lane('l_exploration', 'exploration', 8, ['l_preference', 'l_frontier'])},
        l AS (SELECT * FROM l_preference UNION ALL SELECT * FROM l_frontier UNION ALL SELECT * FROM l_exploration)
        SELECT paper_id, coalesce(lane, 'deferred') AS lane, greatest(relevance, frontier, exploration) AS final_score FROM pr LEFT JOIN l USING (paper_id)""",
    "passage_pack": r"""
        WITH RECURSIVE blocks AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS para FROM (
            SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents)),
        long AS (SELECT doc_id, para, s, len(s) AS n, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(list_slice(s, 1, i), lambda x: length(x)))) AS c FROM (
            SELECT doc_id, para, string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM blocks WHERE length(p) > 1400)),
        walk AS (SELECT doc_id, para, 1::BIGINT AS b, least(n, greatest(1, len(list_filter(c, lambda x: x <= 1400))))::BIGINT AS e FROM long
                 UNION ALL
                 SELECT doc_id, para, e, least(n, greatest(e + 1, len(list_filter(c, lambda x: x - (CASE WHEN e = 1 THEN 0 ELSE c[e - 1] END) <= 1400))))::BIGINT FROM walk JOIN long USING (doc_id, para) WHERE e < n),
        made AS (SELECT doc_id, para, 0 AS b, p FROM blocks WHERE length(p) <= 1400
                 UNION ALL SELECT doc_id, para, b, array_to_string(list_slice(s, b, e), ' ') FROM walk JOIN long USING (doc_id, para))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, b) - 1 AS INTEGER) AS ordinal, md5(p) AS digest, CAST(length(p) AS INTEGER) AS n_chars FROM made WHERE length(p) >= 40""",
    "section_split": f"""WITH {_PAGES}, f AS (SELECT *, length(line) <= 100 AND regexp_full_match(line, '{_HEADING}') AS h FROM lines_),
        s AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY id ORDER BY page, pos) AS s FROM f),
        m AS (SELECT id, s, arg_min(CASE WHEN h THEN line END, (page, pos)) FILTER (h) AS heading, min(page) AS ps FROM s GROUP BY ALL),
        n AS (SELECT *, lead(ps) OVER (PARTITION BY id ORDER BY s) AS nx FROM m),
        b AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY id, s ORDER BY page, pos) AS bl FROM s WHERE NOT h),
        t AS (SELECT id, s, regexp_replace(string_agg(line, chr(10) ORDER BY page, pos), '^\\s+|\\s+$', '', 'g') AS text FROM b WHERE line <> '' OR bl <> '' GROUP BY ALL)
        SELECT n.id AS doc_id, CAST(row_number() OVER (PARTITION BY n.id ORDER BY n.s) - 1 AS INTEGER) AS ordinal, coalesce(heading, 'Document') AS heading, md5(text) AS digest, CASE WHEN heading IS NULL THEN 1 ELSE ps END AS page_start, coalesce(nx, 2) AS page_end FROM n JOIN t ON t.id = n.id AND t.s = n.s WHERE text <> ''""",
    "figure_captions": f"""WITH {_PAGES}, c AS (SELECT *, regexp_matches(line, '(?i)^(figure|fig\\.)\\s*([a-z]?[0-9]+[a-z]?)\\s*[:.]?\\s*(.*)$') AS c, lead(line, 1) OVER w AS one, lead(line, 2) OVER w AS two FROM lines_ WINDOW w AS (PARTITION BY id, page ORDER BY pos))
        SELECT id AS doc_id, page, 'Figure ' || regexp_extract(line, '(?i)^(figure|fig\\.)\\s*([a-z]?[0-9]+[a-z]?)', 2) AS label, regexp_extract(line, '(?i)^(figure|fig\\.)\\s*([a-z]?[0-9]+[a-z]?)\\s*[:.]?\\s*(.*)$', 3) || ' ' || one AS caption FROM c WHERE c AND page = 1""",
    "figure_range_join": """WITH f AS (SELECT o_orderkey % 50 AS version, CAST(o_custkey % 40 AS INTEGER) AS page, CAST(o_orderkey AS VARCHAR) AS label FROM orders),
        p AS (SELECT doc_id % 50 AS version, 'e' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS ev, doc_id % 37 AS ps, doc_id % 37 + doc_id % 5 AS pe FROM documents),
        j AS (SELECT f.*, ev, row_number() OVER (PARTITION BY f.version, page, label ORDER BY ev) AS n FROM f JOIN p ON p.version = f.version AND ps <= page AND pe >= page),
        a AS (SELECT version, page, label, string_agg(ev, ',' ORDER BY ev) AS nearby FROM j WHERE n <= 8 GROUP BY ALL) SELECT f.*, nearby FROM f LEFT JOIN a USING (version, page, label)""",
    "user_turns": f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recent FROM conversations WHERE role = 'user' AND length(trim(text)) BETWEEN 20 AND 12000)
        SELECT conv_id, turn, md5({_redacted('text')}) AS digest, CAST(recent AS INTEGER) AS recent FROM u WHERE recent <= 3""",
    "turn_budget": """WITH c AS (SELECT conv_id, turn, substr(text, 1, 150) AS text FROM conversations), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
        SELECT conv_id, turn, CAST(length(substr(text, 1, CAST(400 - b AS BIGINT))) AS INTEGER) AS n_chars, md5(substr(text, 1, CAST(400 - b AS BIGINT))) AS digest FROM b WHERE b < 400""",
    "research_filter": f"SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(text, '{t.RESEARCH_HINT}')) AS research FROM conversations GROUP BY role",
    "stated_interests": f"""WITH n AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Avoid ' ELSE 'I want ' END || text AS note FROM conversations WHERE role = 'user'),
        e AS (SELECT conv_id, turn, unnest({_INTEREST}) AS part, unnest(range(0, len({_INTEREST}))) AS nth FROM n),
        l AS (SELECT *, substr(regexp_replace(regexp_replace(part, '{t.LEAD_IN}', ''), '^[ :-]+|[ :-]+$', '', 'g'), 1, 160) AS label FROM e)
        SELECT conv_id, turn, CAST(nth AS INTEGER) AS nth, label, CASE WHEN regexp_matches(part, '{t.NEGATIVE_CUE}') THEN 'negative' ELSE 'positive' END AS kind FROM l WHERE length(label) >= 3""",
    "evidence_validation": f"""WITH {_RECORDS}, x AS (SELECT record_id, ver, num, unnest(ev) AS e FROM rec WHERE trim(statement) <> ''),
        s AS (SELECT record_id, count(*) AS n, bool_or(contains(d.text, '4.0')) AS has FROM x JOIN documents d ON d.doc_id = x.e AND d.doc_id % 10 = x.ver GROUP BY record_id)
        SELECT record_id, CAST(len(ev) AS INTEGER) AS cited, round(least(1.0::DOUBLE, confidence), 6) AS confidence FROM rec JOIN s USING (record_id) WHERE n = len(ev) AND (NOT num OR has)""",
    "records_with_evidence": f"""WITH {_RECORDS}, l AS (SELECT DISTINCT l_orderkey % 1000 AS record_id, CAST(l_partkey AS VARCHAR) AS e FROM lineitem) SELECT record_id, round(confidence, 6) AS confidence, string_agg(e, ',' ORDER BY e) AS evidence_ids FROM rec JOIN l USING (record_id) GROUP BY ALL""",
    "missing_evidence": "SELECT DISTINCT l_partkey AS evidence_id FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM documents)",
    "fanout_counts": "SELECT c_custkey AS paper_id, count(DISTINCT o_orderkey) AS records, count(DISTINCT l_partkey) AS figures FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey",
    "session_counts": f"WITH {EVENTS} SELECT source, count(DISTINCT session_fingerprint) AS sessions, count(event_id) AS events, max(observed_at) AS newest FROM pref GROUP BY source",
    "paper_mean_vectors": "SELECT vec_id % 40 AS paper_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) GROUP BY ALL",
}
