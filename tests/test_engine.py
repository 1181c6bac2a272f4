"""The facade from end to end: ingestion, snapshots, search, look-ups."""

import pytest

from fathomline.plans.engine import Engine
from fathomline.providers import HashProvider

PAPER = """Abstract
We study recovery of tool agents after a failure of their tools, and measure it on 120 tasks.

Experiments
Recovery succeeded in 87.5 percent of the runs when agents planned again after a tool failure.
Figure 1: Recovery rates of the agents by task and tool

Limitations
The study covers only agents that were given a full log of the failure, which is rarely so.
"""
OTHER = "Protein folding at scale. " * 30


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), HashProvider(answers={"novelty": {"verdict": "near", "evidence_ids": ["made up"]}}))
    rows = [("Recovery of Tool Agents", PAPER, ["A"], "Tool failure and recovery.", "2026-01-01", "https://arxiv.org/abs/2601.00001v1", "imported"), ("A synthetic note", "Tool failure notes that nobody should cite, since they were made up for a test.", [], "", None, None, "synthetic")]
    assert e.ingest(_texts(spark, rows), now="2026-02-01T00:00:00+00:00") == {"status": "ingested", "versions": 2}
    return e


def _texts(spark, rows):
    return spark.createDataFrame(rows, "title string, text string, authors array<string>, abstract string, published_date string, source_url string, source_class string")


def test_ingest_is_idempotent(spark, engine):
    again = _texts(spark, [("recovery of  tool agents!", PAPER, ["B"], "", None, None, "imported")])
    assert engine.ingest(again) == {"status": "already_ingested", "versions": 0}
    assert engine.store.read("papers").count() == 2 and engine.store.duplicates("evidence_passages").isEmpty()
    assert {r["heading"] for r in engine.store.read("sections").collect()} == {"Abstract", "Experiments", "Limitations", "Document"}


def test_search_and_synthetic(engine):
    found = engine.search("tool failures")
    assert {r["title"] for r in found["results"]} == {"Recovery of Tool Agents"}
    assert found["warnings"] and found["provenance"]["retriever_version"] == "bm25"
    assert {r["title"] for r in engine.search("tool failure", include_synthetic=True)["results"]} == {"Recovery of Tool Agents", "A synthetic note"}
    none = engine.search("zebra")
    assert none["results"] == [] and any("No matching" in w for w in none["warnings"])
    for bad in (0, 101):
        with pytest.raises(ValueError):
            engine.search("tool", limit=bad)
    with pytest.raises(ValueError):
        engine.search("!!!")


def test_figures(engine):
    found = engine.search_figures("recovery rates")["results"]
    assert [f["label"] for f in found] == ["Figure 1"]
    assert engine.get_figure(found[0]["id"])["nearby_evidence_ids"]


def test_snapshot_hides_later_papers(spark, engine):
    first = engine.create_snapshot("s1", end="2026-12-31", now="2026-02-02T00:00:00")
    assert first["status"] == "published" and first["paper_count"] == 1 and len(first["known_gaps"]) == 4
    assert engine.create_snapshot("s1", end="2026-12-31")["status"] == "already_published"
    engine.ingest(_texts(spark, [("Protein folding", OTHER, [], "Proteins.", "2026-01-03", None, "imported")]), now="2026-02-03T00:00:00+00:00")
    with pytest.raises(ValueError):
        engine.create_snapshot("s1", end="2026-12-31")
    with pytest.raises(ValueError):
        engine.create_snapshot("bad id!")
    assert engine.search("protein")["results"] and not engine.search("protein", snapshot_id="s1")["results"]
    with pytest.raises(KeyError):
        engine.search("protein", snapshot_id="none")
    assert engine.snapshot_info()["id"] == "s1"


def test_hybrid_and_coverage(engine):
    bare = engine.hybrid_search("recovery after failure")
    assert any("No stored embeddings" in w for w in bare["warnings"])
    assert engine.enrich()["embedded"] > 0 and engine.enrich()["embedded"] == 0
    full = engine.hybrid_search("recovery after failure")
    assert full["coverage"]["semantic_index"]["complete"] and full["results"][0]["title"] == "Recovery of Tool Agents"
    near = engine.novelty_check("recovery of agents")
    assert near["assessment"]["evidence_ids"] == [] and near["nearest"]


def test_records_cite_real_evidence(spark, engine):
    passage = next(r for r in engine.search("recovery succeeded")["results"] if "87.5" in r["text"])
    v, e = passage["paper_version_id"], passage["evidence_id"]
    rows = [("empirical_result", v, "It works.", [e, e], ["87.5"], 2.0, "t"), ("empirical_result", v, "Wrong number.", [e], ["99"], 0.5, "t"), ("method", v, "Foreign.", ["ev_none"], [], 0.5, "t"), ("method", v, " ", [e], [], 0.5, "t")]
    df = spark.createDataFrame(rows, "record_type string, paper_version_id string, statement string, evidence_ids array<string>, numeric_values array<string>, confidence double, title string")
    assert engine.add_records(df) == {"stored": 1, "refused": 3}
    got = engine.get_scientific_records(record_types=["empirical_result"])
    assert [(r["confidence"], r["evidence_ids"]) for r in got] == [(1.0, [e])]


def test_new_version_and_favourites(spark, engine):
    paper = engine.search("recovery")["results"][0]["paper_id"]
    old = engine.get_paper(paper)["paper_version_id"]
    engine.ingest(_texts(spark, [("Recovery of Tool Agents", PAPER + "\nConclusion\nAgents recover when they are told what went wrong in their tools.", [], "", None, None, "imported")]), now="2026-03-01T00:00:00+00:00")
    now = engine.get_paper(paper)
    assert now["paper_version_id"] != old and now["abstract"] == "Tool failure and recovery." and not now["is_favorite"]
    assert engine.get_paper(paper, snapshot_id="s1")["paper_version_id"] == old
    engine.set_favorite(paper, True)
    assert engine.get_paper(paper)["is_favorite"]
    engine.set_favorite(paper, False)
    assert not engine.get_paper(paper)["is_favorite"]
    with pytest.raises(KeyError):
        engine.set_favorite("none", True)


def test_catalog_and_tools(spark, engine):
    stored = engine.store.read("discovery_records")
    rows = spark.createDataFrame([("d1", "r", "arxiv", "2601.1v1", "Tool agents", "About tools", ["X"], ["cs.AI"], "cs.AI", "2026-01-01", "2026-01-02", None, None, "acquired", "p1", 1, None, None, None), ("d2", "r", "arxiv", "2601.2v1", "Protein maps", "About folding", ["Y"], ["q-bio", "cs.AI"], "q-bio", "2026-01-05", "2026-01-06", None, None, "discovered", None, 0, None, None, None)], stored.schema)
    engine.add_discoveries(rows)
    assert [r["id"] for r in engine.search_catalog("tool protein", category="cs.AI")["results"]] == ["d2", "d1"]
    assert [r["id"] for r in engine.search_catalog("tool protein", category="cs.AI", primary_only=True)["results"]] == ["d1"]
    assert engine.search_metadata("protein folding")[0]["score"] < 0 and engine.search_metadata("protein tools") == []
    assert engine.tool("get_corpus_status", {})["catalog_papers"] == 2
    assert engine.tool("get_research_groups", {"today": "2026-04-01"})["status"] == "not_ready"
    with pytest.raises(KeyError):
        engine.tool("nothing", {})
