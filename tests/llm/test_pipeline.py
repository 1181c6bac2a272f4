import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import queries
from fathomline.llm.storage import discard, stage

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = queries.documents(spark, SF)
    before = docs.count()
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= before
            before = out.count()
            docs = out
        else:
            tokens = out.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in tokens) <= 1024
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_odd_documents(spark):
    rows = [(0, "der die das ein", "de", "s", 15), (1, None, "de", "s", None), (2, "", None, None, 0), (3, "der  die das ein", "de", "s", 16), (None, "ein haus steht", "de", "s", 1), (3, "der  die das ein", "de", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), f"odd-{name}")
        if name == "language":
            assert docs.count() == 4
        if name == "exact":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["0", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, empty, SF)
        assert out.count() == 0


def test_pipeline_near_stage_keeps_what_is_less_similar(spark):
    """96 shingles each, of which 84 (0.778) or 86 (0.811) are in both."""
    rows = []
    for k, new in enumerate([12, 12, 12, 10]):
        base = [f"d{k}w{j}" for j in range(100)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-new], *(f"e{k}w{j}" for j in range(new))]))]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()) == [0, 1, 2, 3, 4, 5, 6]


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_brute_force(spark):
    """Each stage on its own input, against a plain reading of what stays."""
    import re
    import zlib

    import numpy as np

    from tests.llm.test_models import plain_language

    docs = queries.documents(spark, SF).unionByName(spark.createDataFrame([(9000, "漢字 仮名 交じり 文 章 です", "ja", "s", 1), (9001, "123 456", "en", "s", 7), (9002, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    lang = plain_language([(r["doc_id"], r["text"], r["lang"] if i < 9000 else None) for i, r in rows.items()])
    docs = docs.withColumn("lang", F.expr("CASE WHEN doc_id < 9000 THEN lang END"))
    out = {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), f"brute-{name}")
        out[name] = docs.collect()
    kept = {r["doc_id"]: r["lang"] for r in out["language"]}
    assert kept == {i: x for i, (x, score) in lang.items() if x != "und" and score >= 0.2} and not kept.keys() & {9000, 9001, 9002}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]), i)
    assert sorted(r["doc_id"] for r in out["exact"]) == sorted(first.values())
    sets = {i: plain_shingles(rows[i]["text"]) for i in first.values()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in out["near"]) == sorted({find(i) for i in sets})
    assert sorted(r["doc_id"] for r in out["pii"]) == sorted({find(i) for i in sets})
    for r in out["pii"]:
        assert r["n_chars"] == len(r["text"])
        for secret in re.findall(r"[\w.]+@[\w.]+|\b[0-9a-f]{40}\b|\(\d{3}\) \d{3}-\d{4}", rows[r["doc_id"]]["text"]):
            assert secret not in r["text"]
    pieces = {}
    for r in out["packing"]:
        pieces.setdefault(r["doc_id"], []).append(r)
    encode = queries.document_ids()
    for r in out["pii"]:
        ids, at = np.array([*encode(r["text"]), 0], "<u4"), 0
        for piece in sorted(pieces.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert piece["start"] == at and piece["ids_crc32"] == zlib.crc32(ids[at : at + piece["length"]].tobytes())
            at += piece["length"]
        assert at == len(ids) == piece["doc_tokens"]
    assert not pieces


def test_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    from fathomline.llm import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}/own")
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.split("-")[:2] for p in (tmp_path / "own").iterdir()] == [["pipeline", "packing"]]


def test_pipeline_long_text(spark):
    """A document of over a million characters, and its near copy."""
    import random
    import zlib

    rng = random.Random(6)
    text = " ".join(rng.choice(["der", "haus", "eine", "schön", "und"]) + str(rng.randrange(10**4)) for _ in range(130_000))
    assert len(text) > 1 << 20
    rows = [(4, text, "de", "s", 1), (5, text + " ende", "de", "s", 1), (6, "der  die das ein", "de", "s", 16)]
    learned = next(k for k in range(7, 99) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows.append((learned, "das haus und der garten sind eine schön lange geschichte", "de", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), f"long-{name}")
    assert {r["doc_id"] for r in docs.collect()} == {4, 6, learned}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, SF).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_queries_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.count() > 0


def test_discard(spark):
    kept = stage(spark.range(3).toDF("x"), "gone")
    path = kept._staged_at
    discard(kept)
    import os

    assert not os.path.exists(path.removeprefix("file:"))
