"""Extraction, stored organisation and the daily digest, from end to end."""

import datetime

import pytest

from fathomline.plans import organisation
from fathomline.plans.digest import Digest
from fathomline.plans.engine import Engine
from fathomline.plans.extraction import TYPES, extract
from fathomline.plans.organisation import Organisation
from fathomline.providers import HashProvider

NOW = datetime.datetime(2026, 2, 3, 8, 0)
RECOVERY = "Abstract\nRecovery of tool agents after failures of their tools, measured on 120 tasks by planning again.\nFigure 1: Recovery rates of agents by task\n"
FOLDING = "Abstract\nProtein folding maps at scale, predicted for 9000 chains by one network without templates.\n"


def reader(**settings):
    """A provider that answers extraction from the evidence that it is shown; a local class, so that workers need not import this module."""
    import json

    class Reader(HashProvider):

        def structured(self, prompt, schema):
            if not prompt.startswith("extract"):
                return super().structured(prompt, schema)
            asked = json.loads(prompt.removeprefix("extract "))
            shown = asked["evidence"].split("]")[0] + "]"
            if asked["record_type"] != "empirical_result":
                return {}
            number = "120" if "120" in asked["evidence"] else "9000"
            return {"records": [{"statement": f"Measured on {number}.", "evidence_ids": [shown, shown], "numeric_values": [number], "confidence": 3}, {"statement": "Invented.", "evidence_ids": ["ev_none"], "numeric_values": [], "confidence": 0.5}, "no record", {"statement": "Wrong.", "evidence_ids": [shown], "numeric_values": ["77"], "confidence": 0.1}]}

    return Reader(**settings)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("daily")), reader())
    rows = [("The Recovery of Tool Agents", RECOVERY, ["A"], "Tool agents recover from failures.", "2026-01-01", "https://x/1", "imported"), ("Recovery for Tool Agents", RECOVERY + "More of the same on agents and tools.", ["B"], "Tool agents recover from failures.", "2026-01-02", "https://x/2", "imported"), ("Protein folding maps", FOLDING, ["C"], "Proteins fold.", "2026-01-03", "https://x/3", "imported")]
    e.ingest(spark.createDataFrame(rows, "title string, text string, authors array<string>, abstract string, published_date string, source_url string, source_class string"), now="2026-02-01T00:00:00+00:00")
    e.create_snapshot("s", now="2026-02-02T00:00:00")
    return e


def ids(engine):
    return {r["canonical_title"]: r["id"] for r in engine.store.read("papers").collect()}


def test_extraction_replaces_and_resumes(engine):
    first = extract(engine)
    assert (first["paper_count"], first["accepted_records"], first["rejected_records"]) == (3, 3, 9)
    log = engine.store.read("scientific_extractions")
    assert log.count() == 3 * len(TYPES) and engine.store.duplicates("scientific_extractions").isEmpty()
    assert extract(engine, skip_completed=True)["accepted_records"] == 0
    again = extract(engine, paper_id=ids(engine)["Protein folding maps"], types=("empirical_result",))
    assert (again["accepted_records"], engine.store.read("scientific_records").count(), engine.store.read("record_evidence").count()) == (1, 3, 3)
    assert {r["confidence"] for r in engine.get_scientific_records()} == {1.0}
    for bad, error in (({"types": ("nothing",)}, ValueError), ({"limit": 0}, ValueError), ({"paper_id": "none"}, KeyError)):
        with pytest.raises(error):
            extract(engine, **bad)
    assert extract(engine, limit=1, start="2026-01-02", types=("method",))["paper_count"] == 1


def test_organisation_is_stored(engine):
    assert engine.tool("get_research_groups", {"today": "2026-02-03"})["status"] == "not_ready"
    made = Organisation(engine).build("s", run_date="2026-02-03", now=NOW, new_papers=[ids(engine)["Recovery for Tool Agents"]], threshold=0.4)
    assert made["status"] == "ready" and [g["paper_count"] for g in made["groups"]] == [2, 1]
    assert made["groups"][0]["label"] == "Recovery for Tool Agents" and made["groups"][0]["new_count"] == 1 and made["groups"][0]["top_terms"]
    assert made["groups"][0]["average_similarity"] <= 1 and made == engine.tool("get_research_groups", {"today": "2026-02-03"})
    again = Organisation(engine).build("s", run_date="2026-02-03", now=NOW, threshold=0.4)
    assert engine.store.read("paper_clusters").count() == 2 and engine.store.read("paper_cluster_members").count() == 3
    assert again["groups"][0]["new_count"] == 0


def test_a_reader_refines_and_a_broken_answer_changes_nothing(spark, engine):
    papers = list(ids(engine).values())
    good = {"groups": [{"title": "All of it", "description": "d", "shared_problem": "p", "paper_ids": papers, "membership_confidence": 0.5}]}
    made = Organisation(engine, HashProvider(answers={"partition": good})).build("s", run_date="2026-02-04", now=NOW)
    assert [(g["label"], g["paper_count"], g["average_similarity"]) for g in made["groups"]] == [("All of it", 3, 0.5)]
    bad = {"groups": [good["groups"][0] | {"paper_ids": papers[:2]}]}
    labels = {"labels": [{"ordinal": 0, "title": "Agents that recover", "description": "d"}, {"ordinal": 1, "title": "agents that Recover", "description": "d"}, {"ordinal": 9, "title": "No such group", "description": "d"}]}
    made = Organisation(engine, HashProvider(answers={"partition": bad, "label": labels})).build("s", run_date="2026-02-05", now=NOW, threshold=0.4)
    assert sorted(g["label"] for g in made["groups"]) == ["Agents that recover", "Protein folding maps"]
    assert organisation.short_title("An " + "word " * 12, 0) == " ".join(["word"] * 9) + "…" and organisation.short_title("", 4) == "Research Group 5"


def test_digest(spark, engine):
    known = ids(engine)
    liked, other = known["The Recovery of Tool Agents"], known["Protein folding maps"]
    engine.enrich()
    engine.set_favorite(liked, True)
    assert [f["paper_id"] for f in engine.favorites()] == [liked]
    daily = Digest(engine)
    profile = daily.personalisation(["Tool agents"])
    assert profile["active"] and profile["top_terms"][:2] == ["agents", "tool"]
    chosen = daily.candidates(list(known.values()), profile).collect()
    assert [r["position"] for r in chosen] == [1, 2, 3] and chosen[-1]["paper_id"] == other and chosen[0]["matches"]
    passages = {r["paper_id"]: r["id"] for r in engine.store.read("evidence_passages").collect()}
    figures = {r["paper_id"]: r["id"] for r in engine.store.read("visual_evidence").collect()}

    def article(paper, mode, **changes):
        cited = [passages[paper], *([figures[paper]] if paper in figures else [])]
        return {"paper_id": paper, "mode": mode, "reason": "because it is of interest", "title": "A title: of it", "dek": "d", "surprise": "s", "body": "word " * 700 + " ".join(cited), "themes": ["agents"], "evidence_ids": [passages[paper]], "figure_ids": cited[1:], "related_ids": [], "matched_favourites": [liked] if mode == "preference" else [], "matched_labels": []} | changes

    def run(*articles, papers=None):
        engine.provider = reader(answers={"digest:": {"headline": "h", "articles": list(articles)}})
        return daily.generate("s", papers if papers is not None else list(known.values()), "claude", run_date="2026-02-03", now=NOW, profile=profile, most=2)

    for wrong in ([article(liked, "preference")], [article(liked, "editorial"), article(other, "editorial")], [article(liked, "preference", body="short"), article(other, "exploration")], [article(liked, "preference"), article(other, "exploration", evidence_ids=[passages[liked]])]):
        with pytest.raises(ValueError):
            run(*wrong)
        assert engine.store.read("daily_digest_runs").first()["status"] == "failed" and engine.store.read("daily_blogs").isEmpty()
    assert set(daily.daily_papers("none", "s", "claude", [])) == set(known.values())
    done = run(article(liked, "preference"), article(other, "exploration"), papers=[])
    assert done["status"] == "complete" and len(done["blogs"]) == 2 and done["blogs"][0]["slug"] == "2026-02-03-a-title-of-it"
    assert run(papers=[])["status"] == "already_complete" and daily.daily_papers("none", "s", "claude", []) == []
    assert daily.blog(done["blogs"][0]["blog_id"])["mode"] in ("preference", "exploration")
    assert len(daily.dashboard()["runs"][0]["blogs"]) == 2 and daily.personalisation()["themes"] == ["agents"]
    assert daily.generate("s", [], "codex", run_date="2026-02-03", now=NOW)["status"] == "no_new_papers"
    with pytest.raises(ValueError):
        daily.generate("s", [], "other", run_date="2026-02-03", now=NOW)
