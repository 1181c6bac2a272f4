"""Queries: lexical and vector search, fusion, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.functions import vectors as v
from fathomline.operators import cluster, fusion, lexical
from fathomline.plans.views import PAPERS, VECTORS, papers, table, vectors

ITEM = 0


def _items(spark, sf_dir, start=0, stop=20):
    """Words of the first benchmark text: one small row on the driver, as a caller's query string would be."""
    row = table(spark, sf_dir, "benchmark").orderBy("item_id").select(t.words(F.col("text")).alias("w")).first()
    return row["w"][start:stop]


def bm25_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir)]
    docs = papers(spark, sf_dir)
    return lexical.search(docs, {"title": 5, "abstract": 3}, items, id="paper_id", limit=20, keep=F.col("source_class") != "synthetic").select("paper_id", "score")


def bm25_and_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir, 0, 3)]
    return lexical.search(papers(spark, sf_dir), {"title": 4, "abstract": 1}, items, id="paper_id", limit=20, every=True).select("paper_id", "score")


def bm25_phrase_search(spark, sf_dir):
    w = _items(spark, sf_dir, 0, 6)
    return lexical.search(table(spark, sf_dir, "documents"), {"text": 1}, [w[0:2], w[2:4], w[4:6]], id="doc_id", limit=20).select("doc_id", "score")


def catalog_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir, 0, 8)]
    keep = (F.col("lang") == "en") & (F.col("published_date") >= "2024-02-01") & (F.col("published_date") <= "2025-06-30")
    return lexical.search(papers(spark, sf_dir), {"title": 5, "abstract": 2, "lang": 0.2}, items, id="paper_id", limit=20, keep=keep).select("paper_id", "score", "published_date")


def batch_search(spark, sf_dir):
    return lexical.search_many(table(spark, sf_dir, "documents"), "text", "doc_id", table(spark, sf_dir, "benchmark"), "item_id", "text", top=10).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


def related_terms(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", F.array_join(t.related_terms(F.concat_ws(" ", "title", "abstract")), " ").alias("terms"))


def related_papers(spark, sf_dir):
    docs = papers(spark, sf_dir)
    own = docs.filter("paper_id = 1").select(t.related_terms(F.concat_ws(" ", "title", "abstract")).alias("w")).first()
    items = [[w] for w in (own["w"] if own else [])]
    found = lexical.search(docs, {"title": 5, "abstract": 2}, items, id="paper_id", limit=15)
    return found.filter("paper_id <> 1").orderBy(F.desc("score"), "paper_id").limit(10).select("paper_id", "score")


def _query_vector(spark, sf_dir):
    return vectors(spark, sf_dir).filter("vec_id = 0").first()["v"]


def cosine_topk(spark, sf_dir):
    return fusion.dense_search(vectors(spark, sf_dir), "v", _query_vector(spark, sf_dir), id="vec_id", limit=25).withColumnRenamed("id", "vec_id")


def label_centroids(spark, sf_dir):
    return fusion.centroids(vectors(spark, sf_dir), "label", "v").select(F.col("group").alias("label"), "dim", F.round("value", 6).alias("value"))


def folded_vectors(spark, sf_dir):
    folded = vectors(spark, sf_dir).select("vec_id", v.folded(F.col("v"), 48).alias("f"))
    return folded.select("vec_id", F.posexplode("f").alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


def hybrid_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir)]
    lexical_hits = lexical.search(table(spark, sf_dir, "documents"), {"text": 1}, items, id="doc_id", limit=100).select(F.col("doc_id").alias("id"), "score")
    dense = fusion.dense_search(vectors(spark, sf_dir), "v", _query_vector(spark, sf_dir), id="vec_id", limit=100).select("id", F.col("similarity").alias("score"))
    return fusion.fused(lexical_hits, dense, 20)


def semantic_coverage(spark, sf_dir):
    passages = table(spark, sf_dir, "documents").select("doc_id")
    return fusion.coverage(passages, vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id")), "doc_id")


def missing_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def novelty_selection(spark, sf_dir):
    # ranked passages, several of one paper: vectors by similarity, the label as paper
    near = fusion.dense_search(vectors(spark, sf_dir), "v", _query_vector(spark, sf_dir), id="vec_id", limit=100)
    joined = near.join(vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("id") % 23).alias("paper")), "id")
    from pyspark.sql import Window

    ranked = joined.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).alias("rank"), "paper")
    return fusion.novelty_cut(ranked, 12)


def jaccard_pairs(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return cluster.jaccard_links(docs.select("paper_id", t.token_set(F.col("abstract"), t.CLUSTER_STOP).alias("tokens")), "paper_id", F.col("tokens"), 0.8)


def top_terms(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return cluster.top_terms(docs.select(F.col("source").alias("cluster"), "paper_id", t.token_set(F.concat_ws(" ", "title", "abstract"), t.CLUSTER_STOP).alias("tokens"))).select("cluster", "term", F.col("rank").cast("int").alias("rank"), "weight")


def leader_clusters(spark, sf_dir):
    own = papers(spark, sf_dir).select(F.col("paper_id").cast("string").alias("paper_id"), "title", "abstract", "source")
    folded = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("paper_id"), v.folded(F.col("v")).alias("vector"))
    held = cluster.features(own.select("paper_id", "title", "abstract"), folded).join(own.select("paper_id", "source"), "paper_id")
    return cluster.leader_clusters(held, scope="source")


def theme_overlap(spark, sf_dir):
    """Ordered-distinct tokens and their overlap with the tokens of paper 0."""
    docs = papers(spark, sf_dir).select("paper_id", t.token_set(F.col("title"), t.RANKING_STOP).alias("k"))
    first = docs.filter("paper_id = 0").select(F.col("k").alias("k0"))
    return docs.crossJoin(F.broadcast(first)).select("paper_id", F.size("k").alias("tokens"), F.size(F.array_intersect("k", "k0")).alias("shared"), F.array_join(F.slice("k", 1, 3), " ").alias("first_tokens"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_and_search, bm25_phrase_search, catalog_search, batch_search, related_terms, related_papers, cosine_topk, label_centroids, folded_vectors, hybrid_search, semantic_coverage, missing_embeddings, novelty_selection, jaccard_pairs, top_terms, leader_clusters, theme_overlap)}

W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_COS = "list_sum(list_transform(list_zip(a.v, q.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x))))"


def _bm25(rows: str, id: str, fields: dict[str, float], items: str, limit: int, keep: str = "TRUE", every: bool = False, extra: str = "", phrases: bool = False) -> str:
    """SQL of a BM25 search. items: a subquery with (k, item), item a list of words."""
    tokens = ", ".join(f"{W.format(n)} AS t_{n}" for n in fields)
    length = " + ".join(f"len(t_{n})" for n in fields)
    count = " + ".join(f"{w} * len(list_filter(t_{n}, lambda x: x = item[1]))" if not phrases else f"{w} * len(list_filter(range(1, len(t_{n}) - len(item) + 2), lambda i: list_slice(t_{n}, i, i + len(item) - 1) = item))" for n, w in fields.items())
    return f"""
        base AS (SELECT *, {tokens} FROM {rows}),
        sized AS (SELECT *, {length} AS dl FROM base),
        stats AS (SELECT count(*) AS n, avg(dl) AS av FROM sized),
        items AS ({items}),
        tf AS (SELECT {id}, dl, k, CAST({count} AS DOUBLE) AS f FROM sized, items),
        df AS (SELECT k, count(*) AS df FROM tf WHERE f > 0 GROUP BY k),
        part AS (SELECT {id}, tf.k, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
                 * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / av)) AS s FROM tf JOIN df USING (k), stats WHERE f > 0),
        total AS (SELECT {id}, round(sum(s), 6) AS score FROM part GROUP BY {id} {"HAVING count(*) = (SELECT count(*) FROM items)" if every else ""}),
        hits AS (SELECT total.{id}, score {extra} FROM total JOIN {rows} AS r ON r.{id} = total.{id} WHERE {keep} ORDER BY score DESC, total.{id} LIMIT {limit})"""


def _words(start: int, stop: int) -> str:
    return f"SELECT i AS k, [w[i]] AS item FROM (SELECT {W.format('text')} AS w FROM benchmark ORDER BY item_id LIMIT 1), (SELECT unnest(range({start + 1}, {stop + 1})) AS i) WHERE i <= len(w)"


_STOP = {name: "[" + ", ".join(f"'{x}'" for x in getattr(t, name)) + "]" for name in ("RANKING_STOP", "PROFILE_STOP", "CLUSTER_STOP", "DIGEST_STOP")}


def sql_tokens(text: str, stop: str, ordered: bool = False) -> str:
    """Distinct tokens without stop words, if asked in order of first occurrence."""
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z][a-z0-9-]{{2,}}')"
    if ordered:
        return f"list_filter({found}, lambda x, i: NOT list_contains({_STOP[stop]}, x) AND list_position({found}, x) = i)"
    return f"list_filter(list_distinct({found}), lambda x: NOT list_contains({_STOP[stop]}, x))"


_RELATED = """rel AS (
    SELECT paper_id, list(t ORDER BY i) AS w FROM (
        SELECT paper_id, t, min(i) AS i FROM (SELECT paper_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM (SELECT paper_id, regexp_extract_all(lower(title || ' ' || abstract), '[A-Za-z][A-Za-z0-9-]{3,}') AS ts FROM papers))
        WHERE t NOT IN ('this', 'that', 'with', 'from', 'using', 'paper', 'based', 'their') GROUP BY paper_id, t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY min(i)) <= 12)
    GROUP BY paper_id)"""


def _batch(asked: str) -> str:
    """SQL of a search for each benchmark text. asked: its words that count."""
    return f"""
        WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({asked}) AS term FROM benchmark) GROUP BY ALL),
        base AS (SELECT doc_id, {W.format('text')} AS w FROM documents),
        stats AS (SELECT count(*) AS n, avg(len(w)) AS av FROM base),
        post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM base) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        part AS (SELECT doc_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av)) AS s FROM post JOIN df USING (term), stats),
        total AS (SELECT item_id, doc_id, round(sum(s * times), 6) AS score FROM part JOIN asked USING (term) GROUP BY ALL)
        SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total) WHERE rank <= 10"""


ORACLE_SQL = {
    "bm25_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 5, 'abstract': 3}, _words(0, 20), 20, keep='''r.source_class <> 'synthetic' ''')} SELECT * FROM hits",
    "bm25_and_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 4, 'abstract': 1}, _words(0, 3), 20, every=True)} SELECT * FROM hits",
    "bm25_phrase_search": f"WITH {_bm25('documents', 'doc_id', {'text': 1}, f'''SELECT i AS k, [w[i], w[i + 1]] AS item FROM (SELECT {W.format('text')} AS w FROM benchmark ORDER BY item_id LIMIT 1), (SELECT unnest([1, 3, 5]) AS i)''', 20, phrases=True)} SELECT * FROM hits",
    "catalog_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 5, 'abstract': 2, 'lang': 0.2}, _words(0, 8), 20, keep='''r.lang = 'en' AND r.published_date >= '2024-02-01' AND r.published_date <= '2025-06-30' ''', extra=', r.published_date')} SELECT * FROM hits",
    "batch_search": _batch(f"list_slice({W.format('text')}, 1, 20)"),
    "related_terms": f"WITH {PAPERS}, {_RELATED} SELECT p.paper_id, coalesce(array_to_string(w, ' '), '') AS terms FROM papers p LEFT JOIN rel USING (paper_id)",
    "related_papers": f"WITH {PAPERS}, {_RELATED}, {_bm25('papers', 'paper_id', {'title': 5, 'abstract': 2}, f'SELECT i AS k, [w[i]] AS item FROM (SELECT w FROM rel WHERE paper_id = 1), (SELECT unnest(range(1, 13)) AS i) WHERE i <= len(w)', 15)} SELECT * FROM hits WHERE paper_id <> 1 ORDER BY score DESC, paper_id LIMIT 10",
    "cosine_topk": f"WITH {VECTORS} SELECT a.vec_id, round({_COS}, 6) AS similarity FROM vec a, (SELECT v FROM vec WHERE vec_id = 0) q ORDER BY similarity DESC, a.vec_id LIMIT 25",
    "label_centroids": f"WITH {VECTORS}, m AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM vec) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, CAST(dim AS INTEGER) AS dim, round(m / n, 6) AS value FROM m JOIN n USING (label)",
    "folded_vectors": f"""
        WITH {VECTORS}, s AS (SELECT vec_id, dim % 48 AS d, x * CASE WHEN (((dim * 2654435761) >> 8) & 1) = 1 THEN 1.0 ELSE -1.0 END AS x FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM vec)),
        f AS (SELECT vec_id, d, CAST(sum(x) AS DOUBLE) AS x FROM s GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM f GROUP BY vec_id)
        SELECT vec_id, CAST(d AS INTEGER) AS dim, round(x / n, 6) AS x FROM f JOIN n USING (vec_id)""",
    "hybrid_search": f"""
        WITH {VECTORS}, {_bm25('documents', 'doc_id', {'text': 1}, _words(0, 20), 100)},
        den AS (SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM vec a, (SELECT v FROM vec WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 100),
        b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 0 AS list, 'lexical' AS reason FROM hits
              UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id), 1, 'semantic' FROM den)
        SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM b GROUP BY id ORDER BY score DESC, min((list, rank)), id LIMIT 20""",
    "semantic_coverage": "SELECT count(*) AS eligible, count(v.vec_id) AS embedded, round(count(v.vec_id) / count(*), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "novelty_selection": f"""
        WITH RECURSIVE {VECTORS}, near AS (SELECT a.vec_id AS id, round({_COS}, 6) AS s FROM vec a, (SELECT v FROM vec WHERE vec_id = 0) q ORDER BY s DESC, id LIMIT 100),
        r AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, id % 23 AS paper FROM near),
        walk AS (SELECT 0::BIGINT AS rank, []::BIGINT[] AS seen, 0 AS n, NULL::BIGINT AS taken
                 UNION ALL
                 SELECT r.rank, CASE WHEN list_contains(seen, paper) THEN seen ELSE list_append(seen, paper) END,
                        CASE WHEN len(seen) >= 12 AND list_contains(seen, paper) THEN n ELSE n + 1 END,
                        CASE WHEN len(seen) >= 12 AND list_contains(seen, paper) THEN NULL ELSE paper END
                 FROM walk JOIN r ON r.rank = walk.rank + 1 WHERE NOT (len(seen) >= 12 AND n >= 24))
        SELECT rank, taken AS paper FROM walk WHERE taken IS NOT NULL""",
    "jaccard_pairs": f"""
        WITH {PAPERS}, k AS (SELECT paper_id, list_sort({sql_tokens('abstract', 'CLUSTER_STOP')}) AS k FROM papers),
        own AS (SELECT paper_id, k, min(paper_id) OVER (PARTITION BY k) AS rep FROM k WHERE len(k) > 0),
        e AS (SELECT paper_id, len(k) AS n, unnest(k) AS x FROM own WHERE paper_id = rep),
        c AS (SELECT a.paper_id AS a, b.paper_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.paper_id < b.paper_id GROUP BY ALL)
        SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM c WHERE round(c / (na + nb - c), 6) >= 0.8
        UNION ALL SELECT rep, paper_id, 1.0::DOUBLE FROM own WHERE paper_id <> rep""",
    "top_terms": f"""
        WITH {PAPERS}, e AS (SELECT source AS cluster, paper_id, unnest({sql_tokens("title || ' ' || abstract", 'CLUSTER_STOP')}) AS term FROM papers),
        df AS (SELECT term, count(*) AS df FROM e GROUP BY term), tf AS (SELECT cluster, term, count(*) AS tf FROM e GROUP BY ALL),
        s AS (SELECT cluster, term, round(tf * (ln(((SELECT count(*) FROM papers) + 1) / (df + 1)) + 1.0::DOUBLE), 9) AS w FROM tf JOIN df USING (term))
        SELECT cluster, term, CAST(rank AS INTEGER) AS rank, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, term) AS rank FROM s) WHERE rank <= 6""",
    "theme_overlap": f"""
        WITH {PAPERS}, k AS (SELECT paper_id, {sql_tokens('title', 'RANKING_STOP', ordered=True)} AS k FROM papers)
        SELECT paper_id, CAST(len(k) AS INTEGER) AS tokens, CAST(len(list_filter(k, lambda x: list_contains(k0, x))) AS INTEGER) AS shared, array_to_string(list_slice(k, 1, 3), ' ') AS first_tokens FROM k, (SELECT k AS k0 FROM k WHERE paper_id = 0)""",
}
