"""Ingestion and preferences over a store, with stand-ins for what lies outside."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators.history import stated_interests
from fathomline.plans.engine import Engine
from fathomline.plans.ingestion import Harvest, Ingestion, look_back
from fathomline.plans.preferences import Preferences
from fathomline.providers import HashProvider


class Catalog:
    """Five papers in January, two in February; pages of any size."""

    def __init__(self):
        self.calls = 0
        days = ["2026-01-03", "2026-01-04", "2026-01-05", "2026-01-20", "2026-01-21", "2026-02-01", "2026-02-02"]
        topics = ["agents recover from tool failure", "protein folding maps", "tool agents planning", "galaxies and dust", "language models and memory", "reading agents", "maps of cells"]
        self.rows = [{"source_id": f"26{i}v1", "title": f"Paper {i} {x}", "abstract": f"We study {x} in detail.", "authors": ["A"], "categories": ["cs.AI"], "primary_category": "cs.AI" if i % 4 else "q-bio.BM", "published_date": d, "updated_at": d, "abstract_url": f"https://arxiv.org/abs/26{i}v1", "pdf_url": "u"} for i, (d, x) in enumerate(zip(days, topics, strict=True))]

    def page(self, config, cursor, size):
        self.calls += 1
        own = [r for r in self.rows if config.start <= r["published_date"] <= config.end]
        return own[cursor : cursor + size], len(own)


def fetcher():
    def fetch(row):
        if "galaxies" in row["title"]:
            raise OSError("no such file")
        return f"Abstract\n{row['title']} is a text that is long enough to be a passage of its own.\n"

    return fetch  # made here, so that workers need not import this file


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("flow")), HashProvider())


def test_validation():
    for bad in (Harvest("cs", "2026-01-01", "2026-01-02"), Harvest("cs.AI", "2026-02-01", "2026-01-02"), Harvest("cs.AI", "2026-01-01", "2026-01-02", 0), Harvest("cs.AI", "2026-01-01", "2026-01-02", delay=1.0), Harvest("cs.AI", "2026-01-01", "2026-01-02", limit=0)):
        with pytest.raises(ValueError):
            bad.validate()
    assert look_back("2026-03-01") == ("2026-02-26", "2026-02-28")


def test_ingestion_flow(engine):
    catalog, fetch = Catalog(), fetcher()
    flow = Ingestion(engine, catalog)
    group = flow.discover_monthly(Harvest("cs.AI", "2026-01-01", "2026-02-28", page_size=2))
    assert (group["runs"], group["discovered"], group["primary_total"], group["status"]) == (2, 7, 5, "discovered")
    calls = catalog.calls
    assert flow.discover_monthly(Harvest("cs.AI", "2026-01-01", "2026-02-28", page_size=2))["discovered"] == 7 and catalog.calls == calls
    part = flow.acquire_group(group["id"], fetch, limit=3)
    assert (part["acquired"], part["failed"], part["status"]) == (3, 0, "budgeted")
    full = flow.acquire_group(group["id"], fetch)
    assert (full["acquired"], full["failed"], full["status"]) == (6, 1, "complete")
    failed = engine.store.read("discovery_records").filter("status = 'failed'").first()
    assert (failed["error_code"], failed["attempts"]) == ("OSError", 1)
    assert engine.store.read("papers").count() == 6 and engine.search("protein")["results"]
    # what was acquired is known to a later run over the same days
    again = flow.discover(Harvest("cs.AI", "2026-01-03", "2026-01-05", page_size=10))
    assert again["records_by_status"] == {"acquired": 3}
    with pytest.raises(KeyError):
        flow.status("none")


def test_citations(engine):
    class Counts:
        def lookup(self, ids):
            assert all(i.startswith("ARXIV:26") for i in ids)
            return [{"paperId": "x", "citationCount": 4, "influentialCitationCount": 1, "referenceCount": 9}, None, *[{"citationCount": -1}] * (len(ids) - 2)]

    flow = Ingestion(engine, Catalog())
    told = flow.refresh_citations(Counts(), "2026-03-01")
    assert (told["updated"], told["failed_batches"]) == (1, 0)
    assert engine.store.read("paper_citation_metrics").first()["citation_count"] == 4

    class Broken:
        def lookup(self, ids):
            assert len(ids) == 5
            raise OSError

    told = flow.refresh_citations(Broken(), "2026-03-02")
    assert (told["updated"], told["failed_batches"], told["warnings"]) == (0, 1, ["OSError: "])


def extract(turns):
    got = stated_interests(turns, "text", "session_fingerprint")
    return got.select("session_fingerprint", "nth", "kind", "label", F.lit("c").alias("context"), F.lit(0.9).alias("confidence"), F.lit("explicit").alias("explicitness"))


def test_preferences(spark, engine):
    p = Preferences(engine)
    with pytest.raises(ValueError):
        p.configure(["other"], "2026-03-01")
    p.configure(["codex"], "2026-03-01")
    rows = [("codex", "s1", 1, "user", "I want research on tool agents and planning"), ("codex", "s1", 2, "assistant", "a model answers about research here"), ("claude", "s2", 1, "user", "I want research on protein models and more")]
    turns = spark.createDataFrame([(*r, "2026-02-20") for r in rows], "source string, session string, turn int, role string, text string, observed_at string")
    assert p.sync(turns, extract, "2026-03-01") == {"changed_sessions": 1}
    assert p.sync(turns, extract, "2026-03-02") == {"changed_sessions": 0}
    assert [r["label"] for r in engine.store.read("preference_events").collect()] == ["research on tool agents and planning"]
    assert p.set_note("Focus on memory of models. Avoid galaxies.", "2026-03-01") == {"status": "pending", "events": 2}
    assert p.set_note("Focus on memory of models.", "2026-03-01", lambda one: extract(one)) == {"status": "ready", "events": 1}
    with pytest.raises(ValueError):
        p.set_note("x" * 12_001, "2026-03-01")
    a, b = p.current_profile("2026-03-01", persist=True), p.current_profile("2026-03-01", persist=True)
    assert a == b and a["active_for_ingestion"] and a["concepts"][0]["source"] == "explicit"
    assert engine.store.read("preference_profile_versions").count() == 1
    p.disable("codex", "2026-03-02")
    assert engine.store.read("preference_events").count() == 2
    p.forget("codex")
    assert [r["source"] for r in engine.store.read("preference_events").collect()] == ["dashboard_explicit"]
    assert p.set_note("", "2026-03-03") == {"status": "empty", "events": 0}


def test_prioritise(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    flow, p = Ingestion(engine, Catalog()), Preferences(engine)
    group = flow.discover_monthly(Harvest("cs.AI", "2026-01-01", "2026-02-28"))["id"]
    p.set_note("Focus on tool agents planning.", "2026-03-01")
    got = p.prioritise(group, 4, "2026-03-01T00:00:00", primary_only=False)
    assert sum(got["lane_counts"].values()) == 4 == len(got["selected_discovery_ids"]) and got["lane_counts"]["preference"] == 2
    scores = engine.store.read("paper_priority_scores")
    assert scores.count() == 7 and scores.filter("lane = 'deferred'").count() == 3
    best = scores.filter("lane = 'preference'").join(engine.store.read("discovery_records"), F.col("discovery_id") == F.col("id")).select("title").collect()
    assert any("tool agents planning" in r["title"] for r in best)
