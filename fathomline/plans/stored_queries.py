"""Queries over what is kept on disk: the lexical index and the store of deltas; citation rounds and identifiers in nested JSON. With the SQL that checks them.

Index and store lie in the shared folder under the fingerprint of the table's files: they are made once for a state of the table, and the next query finds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import citations, evidence_ids, postings
from fathomline.plans.search import _batch, _bm25, _items, _words
from fathomline.plans.search import W as WORDS
from fathomline.plans.views import PAPERS, papers, table
from fathomline.sources.shared import fingerprint, shared_dir
from fathomline.sources.tables import Store

PAPER_LAYOUT = postings.Layout(("title", "abstract"), ("source_class", "lang", "published_date"), buckets=32)
TEXT_LAYOUT = postings.Layout(("text",), (), buckets=32)


def _index(spark, rows, layout, id):
    """The index of a whole table, made where there is none for its present files."""
    index = postings.LexicalIndex(spark, f"{shared_dir(spark)}/index-{fingerprint(rows, layout, id)}", layout, id=id)
    index.add(rows, name="whole table")
    return index


def paper_index(spark, sf_dir):
    return _index(spark, papers(spark, sf_dir), PAPER_LAYOUT, "paper_id")


def text_index(spark, sf_dir):
    return _index(spark, table(spark, sf_dir, "documents"), TEXT_LAYOUT, "doc_id")


def stored_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir)]
    found = paper_index(spark, sf_dir).search(items, {"title": 5, "abstract": 3}, limit=20, keep=F.col("source_class") != "synthetic")
    return found.select(F.col("id").alias("paper_id"), "score")


def stored_and_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir, 0, 3)]
    return paper_index(spark, sf_dir).search(items, {"title": 4, "abstract": 1}, limit=20, every=True).select(F.col("id").alias("paper_id"), "score")


def stored_filtered_search(spark, sf_dir):
    items = [[w] for w in _items(spark, sf_dir, 0, 8)]
    keep = (F.col("lang") == "en") & (F.col("published_date") >= "2024-02-01") & (F.col("published_date") <= "2025-06-30")
    return paper_index(spark, sf_dir).search(items, {"title": 5, "abstract": 2}, limit=20, keep=keep).select(F.col("id").alias("paper_id"), "score", "published_date")


def stored_phrase_search(spark, sf_dir):
    w = _items(spark, sf_dir, 0, 6)
    return text_index(spark, sf_dir).search([w[0:2], w[2:4], w[4:6]], {"text": 1}, limit=20).select(F.col("id").alias("doc_id"), "score")


def stored_batch_search(spark, sf_dir):
    found = text_index(spark, sf_dir).search_many(table(spark, sf_dir, "benchmark"), "item_id", "text", field="text", top=10)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))


def stored_increments(spark, sf_dir):
    """The table arrives language by language; each arrival is a segment, then small ones are packed. The answer is that of one index of all."""
    docs = table(spark, sf_dir, "documents")
    index = postings.LexicalIndex(spark, f"{shared_dir(spark)}/increments-{fingerprint(docs, TEXT_LAYOUT)}", TEXT_LAYOUT, id="doc_id")
    for r in docs.select("lang").distinct().orderBy("lang").collect():  # a handful of languages
        index.add(docs.filter(F.col("lang").eqNullSafe(r["lang"])), name=f"language {r['lang']}")
    index.merge()
    items = [[w] for w in _items(spark, sf_dir)]
    return index.search(items, {"text": 1}, limit=100).select(F.col("id").alias("doc_id"), "score")


def stored_changes(spark, sf_dir):
    """A table after loading, filling, replacing, deleting and putting back rows, and merging the deltas; each change has a name, so that running it all again changes nothing."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, f"{shared_dir(spark)}/changes-{fingerprint(docs, 'changes 1')}", parts=8)
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("canonical_title"), F.substring("text", 1, 80).alias("abstract"), "lang", "source", "n_chars")

    def done(name, change):
        with store.transaction(name) as t:
            if name not in t.base.names:
                change(t)

    done("load", lambda t: t.append("papers", own))
    told = F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.concat(F.lit("told "), F.col("id")))
    done("fill", lambda t: t.upsert("papers", own.filter("lang = 'fr'").withColumns({"canonical_title": F.lit("changed"), "abstract": told}), how="fill", fill=["abstract"]))
    done("replace", lambda t: t.upsert("papers", own.filter("lang = 'de'").withColumn("canonical_title", F.concat(F.lit("de "), F.col("id")))))
    done("delete", lambda t: t.delete("papers", own.filter("source = 'src3'").select("id")))
    again = own.filter("source = 'src3' and n_chars % 2 = 0").select("id", F.lit("again").alias("canonical_title"))
    done("put back", lambda t: t.upsert("papers", again, how="first"))
    store.compact("papers")
    return store.read("papers").select("id", F.col("canonical_title").alias("title"), "abstract")


class KeyedCounts:
    """A stand-in for a metadata service whose answers follow from the key: some papers are unknown to it, some counts are broken, some batches fail."""

    def lookup(self, keys: list[str]) -> list:
        if any(k.endswith("9999") for k in keys):
            raise RuntimeError("no answer")
        out = []
        for k in keys:
            n = int(k.rsplit(":", 1)[1])
            out.append(None if n % 7 == 0 else {"paperId": f"W{n}", "citationCount": -1 if n % 11 == 0 else n % 100, "influentialCitationCount": n % 10, "referenceCount": n % 50})
        return out


def citation_round(spark, sf_dir):
    """Counts after a round of asking: the service's where it has them, else those stored before."""
    orders = table(spark, sf_dir, "orders")
    keyed = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("ORDER:"), F.col("o_orderkey").cast("string")).alias("key"))
    stored = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.lit("old").alias("work_id"), *[F.lit(1).alias(c) for c in ("citation_count", "influential_citation_count", "reference_count")])
    # one key a batch, so that what fails doesn't depend on how rows are spread
    return citations.merged(stored, citations.asked(keyed, KeyedCounts(), batch=1, writers=8), "paper_id")


def nested_evidence_ids(spark, sf_dir):
    """Events as nested answers: identifiers at three depths, some twice, some not strings."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    name = lambda k: F.concat(F.lit("e"), ((n * k) % 97).cast("string"))
    payload = F.to_json(F.struct(F.struct(name(1).alias("evidence_id"), F.array(F.struct(F.array(name(2), name(3)).alias("evidence_ids")), F.struct(F.array(name(1), name(5)).alias("evidence_ids"))).alias("parts")).alias("a"), F.struct(n.alias("evidence_id"), F.struct(name(7).alias("evidence_id")).alias("deep")).alias("b"), F.lit("e0").alias("text")))
    return evidence_ids.evidence_ids(e.select("event_id", F.when(n % 10 == 0, F.lit("{broken")).otherwise(payload).alias("payload")), "event_id", "payload")


QUERIES = {f.__name__: f for f in (stored_search, stored_and_search, stored_filtered_search, stored_phrase_search, stored_batch_search, stored_increments, stored_changes, citation_round, nested_evidence_ids)}

_PHRASES = f"SELECT i AS k, [w[i], w[i + 1]] AS item FROM (SELECT {WORDS.format('text')} AS w FROM benchmark ORDER BY item_id LIMIT 1), (SELECT unnest([1, 3, 5]) AS i)"

ORACLE_SQL = {
    "stored_batch_search": _batch(WORDS.format("text")),
    "stored_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 5, 'abstract': 3}, _words(0, 20), 20, keep='''r.source_class <> 'synthetic' ''')} SELECT * FROM hits",
    "stored_and_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 4, 'abstract': 1}, _words(0, 3), 20, every=True)} SELECT * FROM hits",
    "stored_filtered_search": f"WITH {PAPERS}, {_bm25('papers', 'paper_id', {'title': 5, 'abstract': 2}, _words(0, 8), 20, keep='''r.lang = 'en' AND r.published_date >= '2024-02-01' AND r.published_date <= '2025-06-30' ''', extra=', r.published_date')} SELECT * FROM hits",
    "stored_phrase_search": f"WITH {_bm25('documents', 'doc_id', {'text': 1}, _PHRASES, 20, phrases=True)} SELECT * FROM hits",
    "stored_increments": f"WITH {_bm25('documents', 'doc_id', {'text': 1}, _words(0, 20), 100)} SELECT * FROM hits",
    "stored_changes": """
        WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, substr(text, 1, 80) AS abstract, lang, source, n_chars FROM documents),
        c AS (SELECT id, CASE WHEN lang = 'de' THEN 'de ' || id ELSE title END AS title, CASE WHEN lang = 'fr' AND n_chars % 2 <> 0 THEN 'told ' || id ELSE abstract END AS abstract, source, n_chars FROM d)
        SELECT id, CASE WHEN source = 'src3' THEN 'again' ELSE title END AS title, CASE WHEN source = 'src3' THEN NULL ELSE abstract END AS abstract FROM c WHERE source IS DISTINCT FROM 'src3' OR n_chars % 2 = 0""",
    "citation_round": """
        WITH k AS (SELECT o_orderkey AS n FROM orders),
        ok AS (SELECT n FROM k WHERE n % 10000 <> 9999 AND n % 7 <> 0 AND n % 11 <> 0)
        SELECT CAST(n AS VARCHAR) AS paper_id, 'W' || n AS work_id, CAST(n % 100 AS INTEGER) AS citation_count, CAST(n % 10 AS INTEGER) AS influential_citation_count, CAST(n % 50 AS INTEGER) AS reference_count FROM ok
        UNION ALL SELECT CAST(n AS VARCHAR), 'old', 1, 1, 1 FROM k WHERE n % 3 = 0 AND n NOT IN (SELECT n FROM ok)""",
    "nested_evidence_ids": """
        WITH e AS (SELECT event_id, unnest([event_id % 97, event_id * 2 % 97, event_id * 3 % 97, event_id % 97, event_id * 5 % 97, event_id * 7 % 97]) AS m, unnest(range(0, 6)) AS i FROM events WHERE event_id % 10 <> 0),
        f AS (SELECT event_id, m, min(i) AS i FROM e GROUP BY ALL)
        SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS INTEGER) AS pos, 'e' || m AS evidence_id FROM f""",
}
