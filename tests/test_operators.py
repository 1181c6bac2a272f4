"""Small cases whose answers are known, and properties that must hold."""

import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import porter, text, vectors
from fathomline.operators import catalog, cluster, digest, evidence, fusion, history, lexical, parse, profile, ranking, upsert
from fathomline.sources import files, tables
from fathomline.streaming import events as streaming

STEMMED = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli analogousli predication operator feudalism decisiveness hopefulness formaliti sensitiviti triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective probate rate cease roll café running tool-schema x_y yellow yes by toy eyes recoveries agents failures generalization oscillators".split()


def test_search_equals_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, body, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab('f', 'row')")
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(STEMMED) for _ in range(rng.randrange(6))), " ".join(rng.choice(STEMMED) for _ in range(rng.randrange(1, 40)))) for i in range(100)]
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    assert {r[0] for r in db.execute("SELECT term FROM v")} == {s for _, a, b in rows for s in porter.analyse(a) + porter.analyse(b)}
    df = spark.createDataFrame(rows, "id long, title string, body string")
    for query in ("running cafe", "tool-schema x_y hope", "sized sized rate", "- agents"):
        match = " OR ".join(f'"{x}"' for x in re.findall(r"[\w-]+", query))
        want = dict(db.execute("SELECT id, -bm25(f, 0, 5, 1) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r["id"]: r["score"] for r in lexical.scored(df, {"title": 5, "body": 1}, porter.query_phrases(query), analyzer=porter.stems).collect()}
        assert {int(k) for k in want} == set(got) and all(abs(got[int(k)] - s) < 1e-9 for k, s in want.items())
    with pytest.raises(ValueError):
        porter.query_phrases(" ! ")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/2508.01525v3", "  The  Title!  ", "Bearer abcdefghij and sk-abcdefghijklmn, password: hunter2 x", None)], "u string, t string, s string, n string")
    r = df.select(text.scholarly_id(F.col("u")).alias("u"), text.normal_title(F.col("t")).alias("t"), text.redact(F.col("s")).alias("s"), text.clip(F.lit("one two three"), 8).alias("c"), text.stable_id("p", F.col("t"), F.col("n")).alias("i"), text.stable_id("p", F.col("t"), F.lit("")).alias("j")).first()
    assert (r["u"], r["t"], r["c"]) == ("ARXIV:2508.01525", "the title", "one two…")
    assert r["s"] == "[REDACTED] and [REDACTED], [REDACTED] x" and r["i"] == r["j"] and len(r["i"]) == 22


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=200)
    folded = np.zeros(96)
    for i, x in enumerate(v):
        folded[i % 96] += x * (1.0 if (i * 2654435761 >> 8) & 1 else -1.0)
    folded /= np.linalg.norm(folded)
    r = spark.createDataFrame([(v.tolist(), [0.0] * 200, [1.0])], "a array<double>, z array<double>, s array<double>").select(vectors.folded(F.col("a")).alias("f"), vectors.cosine(F.col("a"), F.col("a")).alias("one"), vectors.cosine(F.col("a"), F.col("z")).alias("zero"), vectors.cosine(F.col("a"), F.col("s")).alias("odd"), vectors.normalised(F.col("z")).alias("n")).first()
    assert np.allclose(r["f"], folded) and abs(r["one"] - 1) < 1e-12 and r["zero"] == 0.0 and r["odd"] == -1.0 and r["n"] == [0.0] * 200


def test_fusion_prefers_rows_in_both_lists(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("w", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.8)], "id string, score double")
    got = fusion.fused(a, b, 3).collect()
    assert [r["id"] for r in got] == ["y", "x", "z"] and got[0]["reasons"] == "lexical,semantic"
    assert got[0]["score"] == round(1 / 62 + 1 / 61, 9)


def test_ranking_affinity_and_ties(spark):
    rows = [("a", "Robot planning", "", "2026-07-01", 0.5, None, False), ("b", "Protein maps", "", "2026-07-01", 0.5, None, False), ("c", "protein maps", "", "2026-07-01", 0.5, 3, False), ("d", "x", "", "broken", None, 9, True)]
    df = spark.createDataFrame(rows, "paper_id string, title string, abstract string, published_date string, similarity double, citation_count int, is_new boolean").withColumn("g", F.lit(1))
    liked = ranking.ranked_groups(df, today="2026-08-04", positive=["robot", "planning"], negative=[], active=True, groups=["g"]).orderBy("position").collect()
    assert liked[0]["paper_id"] == "a" and liked[0]["reasons"].startswith("Strong match")
    by = {r["paper_id"]: r for r in ranking.ranked_groups(df, today="2026-08-04", positive=[], negative=[], active=False, groups=["g"]).collect()}
    assert by["c"]["citation"] == 0.5 and by["d"]["citation"] is None and by["d"]["recency"] is None and by["b"]["position"] < by["a"]["position"]


@pytest.mark.parametrize("n,budget,active", [(6, 5, True), (6, 5, False), (3, 2, True), (10, 0, True), (1, 1, True), (0, 5, True)])
def test_lanes_are_disjoint_and_sum_up(spark, n, budget, active):
    q = profile.quotas(n, budget, (0.6, 0.2, 0.2), active)
    assert q["preference"] + q["frontier"] + q["exploration"] == q["target"] and (active or q["preference"] == 0)
    rng = random.Random(n)
    df = spark.createDataFrame([(f"d{i}", rng.random(), rng.random(), rng.random()) for i in range(n)], "id string, relevance double, frontier double, exploration double")
    got = profile.lanes(df, budget, active=active).collect()
    chosen = [r for r in got if r["lane"] != "deferred"]
    assert len(got) == n and len(chosen) == q["target"] and len({r["id"] for r in got}) == n
    if n == 6 and active:
        assert {r["lane"] for r in chosen} == {"preference", "frontier", "exploration"}


def test_quota_rules():
    with pytest.raises(ValueError):
        profile.quotas(5, -1, (0.6, 0.2, 0.2), True)
    with pytest.raises(ValueError):
        profile.quotas(5, 2, (0.6, 0.2, 0.1), True)


def test_oldest_casing_wins(spark):
    rows = [("codex", "s", "topic", "Agents", 1.0, "explicit", "2026-01-01"), ("codex", "s", "topic", "AGENTS", 1.0, "explicit", "2026-02-01"), ("codex", "s", "negative", "noise", 1.0, "inferred", "2026-02-01"), ("codex", "s", "topic", "weak", 0.1, "inferred", "2026-02-01")]
    df = spark.createDataFrame(rows, "source string, session_fingerprint string, kind string, label string, confidence double, explicitness string, observed_at string")
    got = {r["label"]: r for r in profile.label_weights(df, None, F.lit("2026-02-01")).collect()}
    assert set(got) == {"Agents", "noise"} and got["noise"]["polarity"] == "negative" and got["Agents"]["weight"] == round(1 + 0.5 ** (31 / 180), 4)


def test_clusters_split_by_content(spark):
    rows = [("p1", "Tool agents plan", "agents recover failures"), ("p2", "Tool agents replan", "agents recover failures"), ("p3", "Protein folding maps", "proteins fold")]
    held = cluster.features(spark.createDataFrame(rows, "paper_id string, title string, abstract string"), None)
    got = cluster.leader_clusters(held, threshold=0.5, most=2).collect()
    assert sorted((r["cluster"], r["paper_id"]) for r in got) == [(0, "p1"), (0, "p2"), (1, "p3")]


def test_singletons_are_consolidated():
    unit = lambda *x: np.array(x) / np.linalg.norm(x)
    rows = [("a", {"x"}, unit(1, 0)), ("b", {"x"}, unit(1, 0.05)), ("c", {"y"}, unit(1, 1.3))]
    groups = cluster.lead(rows, 0.58, 48)
    assert [[p for p, _ in g.members] for g in groups] == [["a", "b", "c"]]


def test_parsing_edges(spark):
    pages = spark.createDataFrame([("d", 1, "Intro text here\n\n\nMethods\nnot a heading\n1. Introduction\n\nbody one\n"), ("d", 2, "body two\nConclusion"), ("e", 1, ""), ("f", 1, None)], "id string, page int, text string")
    got = [(r["id"], r["ordinal"], r["heading"], r["text"], r["page_start"], r["page_end"]) for r in parse.sections(pages).orderBy("id", "ordinal").collect()]
    assert got == [("d", 0, "Document", "Intro text here\n\nMethods\nnot a heading", 1, 1), ("d", 1, "1. Introduction", "body one\nbody two", 1, 2), ("e", 0, "Document", "", 1, 1), ("f", 0, "Document", "", 1, 1)]


def test_passages_overlap_by_a_sentence(spark):
    sentences = [f"Sentence number {i} is about this long and ends here." for i in range(40)]
    rows = spark.createDataFrame([(1, " ".join(sentences)), (2, "short"), (3, None), (4, "")], "id int, text string")
    got = [(r["id"], r["passage"]) for r in parse.passages(rows, "text", "id", target=200).orderBy("id", "ordinal").collect()]
    assert {i for i, _ in got} == {1}
    texts = [p for _, p in got]
    assert all(len(p) <= 320 for p in texts) and texts[0].startswith(sentences[0]) and texts[-1].endswith(sentences[-1])
    assert all(b.startswith(a.split(". ")[-1].removesuffix(".")) for a, b in zip(texts, texts[1:], strict=False))


def test_upserts_do_not_change_on_rerun(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", "x")], "id int, title string, abstract string")
    new = spark.createDataFrame([(1, "A", "filled"), (2, "B", ""), (3, "c", "y")], "id int, title string, abstract string")
    want = {(1, "a", "filled"), (2, "b", "x"), (3, "c", "y")}
    once = upsert.keep_nonempty(old, new, "id", ["abstract"])
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in upsert.keep_nonempty(once, new, "id", ["abstract"]).collect()}
    assert upsert.same_members(old, old.unionByName(old), ["id"]) and not upsert.same_members(old, new, ["id"])


def test_month_segments(spark):
    got = [tuple(map(str, r)) for r in catalog.month_segments(spark, "2026-01-15", "2026-02-03").collect()]
    assert got == [("2026-01-15", "2026-01-31"), ("2026-02-01", "2026-02-03")]


def test_history_layouts(spark):
    lines = ['{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"plan a study of agents"}]}}', '{"session_id":"s","text":"compare retrieval models"}', '{"type":"user","message":{"role":"user","content":[{"type":"text","text":"evaluate the dataset"}]}}', '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"no"}]}}', "broken {"]
    got = history.events_of_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["role"], r["text"]) for r in got) == [("assistant", "no"), ("user", "compare retrieval models"), ("user", "evaluate the dataset"), ("user", "plan a study of agents")]


def test_article_rules(spark):
    passages = spark.createDataFrame([("e1", "p1"), ("e2", "p2")], "id string, paper_id string")
    figures = spark.createDataFrame([("f1", "p1"), ("f2", "p2")], "id string, paper_id string")
    papers = spark.createDataFrame([("p1", "https://x"), ("p2", None)], "paper_id string, source_url string")
    body, why = "word " * 700 + "e1 f1", "because it is important"
    rows = [
        ("ok", "p1", "preference", why, "t", "d", "s", body, ["x"], ["e1"], ["f1"], ["p2"], ["p2"], ["Agents"]),
        ("bad", "p9", "other", "  short  ", "", "d", "s", "few words", [], ["e2"], ["f2"], ["p0"], ["p1"], ["none"]),
        ("none", "p2", "preference", why, "t", "d", "s", body, ["x"], None, None, None, None, None),
    ]
    got = digest.article_errors(spark.createDataFrame(rows, digest.ARTICLE), candidates=papers.select("paper_id"), passages=passages, figures=figures, papers=papers, favourites=spark.createDataFrame([("p2",)], "paper_id string"), labels=["agents"])
    errors = {}
    for r in got.collect():
        errors.setdefault(r["article"], set()).add(r["error"])
    assert errors == {
        "bad": {"not a candidate", "evidence of another paper", "figure of another paper", "too short", "evidence not inline", "figure not inline", "unknown related paper", "unknown mode", "reason too short", "unknown favourite", "unknown label", "match without preference", "editorial fields missing", "no source address"},
        "none": {"no evidence", "figures left out", "preference without a match", "no source address"},
    }
    assert evidence.mode_errors(["preference", "preference"], True) and not evidence.mode_errors(["preference", "exploration"], True) and evidence.mode_errors(["preference"], False)
    group = {"title": "Two words", "description": "d", "shared_problem": "s", "paper_ids": ["a"], "membership_confidence": 0.5}
    assert evidence.exact_partition([group], ["a"]) and not evidence.exact_partition([group], ["a", "b"]) and not evidence.exact_partition([group | {"membership_confidence": True}], ["a"])


def test_incomplete_batches_are_dropped(spark):
    scores = spark.createDataFrame([(1, "a", 0.5, "r"), (1, "b", None, "r"), (2, "c", 0.1, "r")], "batch int, id string, score double, reason string")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch int, id string")
    assert [r["id"] for r in evidence.complete_batches(scores, "batch", want).collect()] == ["c"]


def test_atom_entries(spark):
    entry = '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/2601.00001v2</id><title>A\n  title</title><summary> Some   text </summary><published>2026-01-02T00:00:00Z</published><updated>2026-01-03T00:00:00Z</updated><author><name>A B</name></author><author><name>C</name></author><category term="cs.AI"/><category term="cs.CL"/><arxiv:primary_category term="cs.AI"/><link href="http://arxiv.org/pdf/2601.00001v2" title="pdf" rel="related"/></entry>'
    r = files.catalog_entries(spark.createDataFrame([(entry,)], "value string")).first()
    assert (r["source_id"], r["title"], r["abstract"], r["authors"], r["categories"], r["primary_category"], r["published_date"], r["pdf_url"]) == ("2601.00001v2", "A title", "Some text", ["A B", "C"], ["cs.AI", "cs.CL"], "cs.AI", "2026-01-02", "http://arxiv.org/pdf/2601.00001v2")


def test_artifacts_and_history_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text":"one"}\n{"text":"two"}\n')
    (tmp_path / "in" / "b.txt").write_bytes(b"abc\xff")
    assert {r["text"] for r in files.whole_texts(spark, str(tmp_path / "in")).collect()} == {'{"text":"one"}\n{"text":"two"}\n', "abc�"}
    lines = files.history_lines(spark, str(tmp_path / "in"))
    assert history.events_of_lines(lines).count() == 2
    seen = lines.select("uri", "digest").distinct()
    assert files.changed(lines, seen).isEmpty()
    stored = files.put_artifacts(files.artifacts(spark, str(tmp_path / "in")).select("content"), str(tmp_path / "out"), "raw")
    assert stored.count() == 2 and files.verified(spark.read.parquet(str(tmp_path / "out" / "raw"))).isEmpty()


def test_store_versions(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    assert len(tables.SCHEMAS) == 33
    assert store.read("papers").isEmpty() and all(store.spark.createDataFrame([], s).columns for s in tables.SCHEMAS.values())
    store.write("paper_favorites", spark.createDataFrame([("p",)], "paper_id string"))
    store.write("paper_favorites", spark.createDataFrame([("p", None), ("p", None)], "paper_id string, created_at timestamp"))
    assert store.read("paper_favorites").count() == 2 and store.duplicates("paper_favorites").count() == 1


def test_stream_replaces_sessions(spark, tmp_path):
    schema = "event_id long, session string, label string"
    source, sink = str(tmp_path / "in"), streaming.SessionSink(spark, str(tmp_path / "out"), ["session"])

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.run_available(streaming.event_stream(spark, source, schema), sink, str(tmp_path / "cp"))

    arrive([(1, "a", "x"), (2, "b", "y")])
    arrive([(3, "a", "z")])
    assert {(r["session"], r["label"]) for r in sink.table().collect()} == {("a", "z"), ("b", "y")}
    before = sink.versions()
    sink(spark.createDataFrame([], schema), before[-1])
    assert sink.versions() == before


def test_stream_windows(spark, tmp_path):
    rows = [(1, "2026-01-01 10:00:00", "a", 1.0), (1, "2026-01-01 10:00:00", "a", 1.0), (2, "2026-01-01 11:00:00", "a", 2.0), (3, "2026-01-09 00:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts string, label string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = streaming.label_windows(streaming.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, label string, value double"), "ts", "label")
    q = stream.writeStream.format("memory").queryName("windows_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["label"], r["events"], r["value"]) for r in spark.table("windows_out").collect()] == [("a", 2, 3.0)]
