"""The queries of this subpackage, each over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bit_sliced, bpe_tree, centroids, exact_dedup, fm_index, language_id, merkle, packing, pieces, pii, simhash, suffix_dedup, training_order
from fathomline.llm.storage import documents, new_path
from fathomline.llm.tokens import DocumentIds


def document_ids(special: bool = True) -> DocumentIds:
    import public_tokenizers as vocabularies

    return DocumentIds(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, special)


def pii_key(spark: SparkSession) -> str:
    """The session's secret; the synthetic tables hold no one's data and do with a fixed one."""
    return spark.conf.get("spark.fathomline.piiKey", "synthetic tables")


def op1_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeated(documents(spark, sf_dir), want_text=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), document_ids())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=pii_key(spark))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "training-order")
    layout = training_order.materialise(documents(spark, sf_dir), document_ids(special=False), target, key=20240229)
    return training_order.read_from(spark, target, layout, ids=False)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.fit_documents(docs)
    return language_id.identify(docs.select("doc_id", "text"), profiles).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(documents(spark, sf_dir), want_text=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    codec = bpe_tree.TreeCodec(vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    return bpe_tree.round_trip(documents(spark, sf_dir), codec)


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return pieces.round_trip(documents(spark, sf_dir), vocabularies.path("piece_bpe_32k.model"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), tampered=merkle.tampered_leaf())


QUERIES = {
    "op1_fm_index": op1_fm_index,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_training_order": op6_training_order,
    "op7_language": op7_language,
    "op8_suffix": op8_suffix,
    "op9_bpe": op9_bpe,
    "op10_exact": op10_exact,
    "op11_pieces": op11_pieces,
    "op12_centroids": op12_centroids,
    "op13_manifest": op13_manifest,
}


def _crc32(text: str) -> str:
    """SQL of the crc32 of a text of ASCII characters."""
    return f"""xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
            lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS BIGINT), CAST(4294967295 AS BIGINT))"""


def _centroid_rounds(rounds: int) -> str:
    """SQL of assigning v(r, q) to c0(k, c), moving the centroids and assigning again: a0, c1, a1, and so on."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
        a{i} AS (SELECT * FROM (SELECT r, vec_id, q, k, c, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        out.append(f"""
        c{i + 1} AS (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
            SELECT k, list((s - (s % n + n) % n) // n ORDER BY dim) AS c FROM (SELECT k, dim, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS dim FROM a{i}) GROUP BY k, dim) GROUP BY k) m USING (k))""")
    return ",".join(out[:-1])


def _leaf(n_chars: str) -> str:
    told = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(told)})"


def _levels(name: str) -> str:
    """SQL of one more level of the lists ``l`` of digests."""
    return f"SELECT * REPLACE (lvl + 1 AS lvl, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) AS l) FROM {name} WHERE len(l) > 1"


ORACLE_SQL = {
    "op1_fm_index": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM p) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 35)) AS k)),
        e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        k AS (SELECT e.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL), '') AS kept
              FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
    "op5_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS HUGEINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, TRY_CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
    """,
    # with at most 1000 labelled documents a language, as in the small tables, the sample to learn from is all of them
    "op7_language": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g'), ' ') AS t, text IS NOT NULL AS told,
                xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                        lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS BIGINT), CAST(4294967295 AS BIGINT)) % 3 = 1 AS held FROM documents),
        ch AS (SELECT r, unnest(string_split(' ' || t || ' ', '')) AS a, unnest(range(0, length(t) + 2)) AS i FROM d WHERE t <> ''),
        n AS (SELECT r, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS e FROM ch WINDOW w AS (PARTITION BY r ORDER BY i)),
        g AS (SELECT r, unnest([CASE WHEN a <> ' ' THEN a END, a || b, CASE WHEN b <> ' ' THEN a || b || e END]) AS g FROM n),
        own AS (SELECT r, g, count(*) AS n, CASE length(g) WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS k FROM g WHERE g IS NOT NULL GROUP BY r, g),
        p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, k, g) - 1 AS place FROM own JOIN d USING (r)
              WHERE told AND lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held GROUP BY lang, g, k QUALIFY place < 400),
        o AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, k, g) - 1 AS place FROM own QUALIFY place < 400),
        x AS (SELECT o.r, l.lang, sum(CASE WHEN p.place IS NULL THEN 400 ELSE abs(p.place - o.place) END) AS distance, count(*) AS n
              FROM o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = o.g GROUP BY o.r, l.lang),
        b AS (SELECT r, lang, 1.0 - CAST(distance AS DOUBLE) / (400 * n) AS score FROM x QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
        SELECT doc_id, coalesce(held, false) AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM d LEFT JOIN b USING (r)
    """,
    "op8_suffix": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
        e AS (SELECT r, o, unnest(b) AS x, unnest(range(1, len(b) + 1)) AS i FROM d),
        s2 AS (SELECT r, o, i, x, x || lead(x, 1) OVER w AS s FROM e WINDOW w AS (PARTITION BY r ORDER BY i)),
        s4 AS (SELECT r, o, i, x, s || lead(s, 2) OVER w AS s FROM s2 WINDOW w AS (PARTITION BY r ORDER BY i)),
        s8 AS (SELECT r, o, i, x, s || lead(s, 4) OVER w AS s FROM s4 WINDOW w AS (PARTITION BY r ORDER BY i)),
        s16 AS (SELECT r, o, i, x, s || lead(s, 8) OVER w AS s FROM s8 WINDOW w AS (PARTITION BY r ORDER BY i)),
        s32 AS (SELECT r, o, i, x, s || lead(s, 16) OVER w AS s FROM s16 WINDOW w AS (PARTITION BY r ORDER BY i)),
        s50 AS (SELECT r, o, i, x, s || lead(s, 18) OVER w AS s FROM s32 WINDOW w AS (PARTITION BY r ORDER BY i)),
        l AS (SELECT s, min(o) AS least FROM s50 WHERE s IS NOT NULL GROUP BY s),
        h AS (SELECT r, i, x, l.least < o AS hit FROM s50 LEFT JOIN l USING (s)),
        m AS (SELECT r, i, x, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM h),
        f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM m),
        g AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY r)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (r)
    """,
    "op10_exact": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY n.t ORDER BY n.doc_id NULLS LAST) = 1 AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
    """,
    "op12_centroids": f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS k, q AS c FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v) QUALIFY k < 16), {_centroid_rounds(3)}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3
    """,
    "op13_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('n_chars')} AS leaf,
                CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS told FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        low AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS l FROM p GROUP BY lang UNION ALL {_levels('low')}),
        sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM low WHERE len(l) = 1),
        high AS (SELECT 0 AS lvl, list(subroot ORDER BY pos) AS l FROM sub UNION ALL {_levels('high')}),
        steps AS (
            SELECT r, lvl AS k, (p.pos >> lvl) % 2 AS side, l[xor(p.pos >> lvl, 1) + 1] AS sib FROM p JOIN low ON low.lang IS NOT DISTINCT FROM p.lang AND len(l) > 1
            UNION ALL SELECT r, 1000 + lvl, (sub.pos >> lvl) % 2, l[xor(sub.pos >> lvl, 1) + 1] FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang, high WHERE len(l) > 1),
        way AS (SELECT r, list(CASE WHEN sib IS NULL THEN 'A' WHEN side = 1 THEN 'L' || sib ELSE 'R' || sib END ORDER BY k) AS way, coalesce(string_agg(sib, '' ORDER BY k), '') AS proof FROM steps GROUP BY r),
        o AS (SELECT p.doc_id, p.leaf, sub.subroot, (SELECT l[1] FROM high WHERE len(l) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                list_reduce(list_prepend(told, coalesce(way, [])), lambda a, b: sha256(CASE b[1] WHEN 'A' THEN a WHEN 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
              FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang LEFT JOIN way USING (r))
        SELECT *, folded_root = root AS verified FROM o
    """,
}
