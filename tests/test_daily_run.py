"""The daily run as remembered steps: broken after each of them, it ends as a run that did not break."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.plans.engine import Engine
from fathomline.plans.ingestion import Harvest
from fathomline.plans.preferences import Preferences
from fathomline.plans.workflow import DailyRun, Steps
from fathomline.providers import HashProvider

NOW = datetime(2026, 2, 3, 8)
CONFIG = Harvest("cs.AI", "2026-02-01", "2026-02-02", page_size=3)


class Catalog:
    def __init__(self):
        self.calls = 0
        self.rows = [{"source_id": f"2602.{i}v1", "title": f"Paper {i} about {x}", "abstract": f"We study {x} in detail.", "authors": ["A"], "categories": ["cs.AI"], "primary_category": "cs.AI", "published_date": "2026-02-01", "updated_at": "2026-02-01", "abstract_url": f"https://arxiv.org/abs/2602.{i}v1", "pdf_url": "u"} for i, x in enumerate(["tool agents", "protein maps", "galaxies", "memory", "reading agents"])]

    def page(self, config, cursor, size):
        self.calls += 1
        return self.rows[cursor : cursor + size], len(self.rows)


def fetcher():
    def fetch(row):
        if "galaxies" in row["title"]:
            raise OSError("no such file")
        return f"Abstract\n{row['title']} is a text that is long enough to be a passage of its own.\n"

    return fetch


def provider(log):
    class Provider(HashProvider):  # made here, so that workers need not import this file
        def structured(self, prompt, schema):
            import json

            if prompt.startswith("relevance: "):
                with open(log, "a") as f:
                    f.write("asked\n")
                papers = json.loads(prompt[11:])["papers"]
                return {"scores": [{"discovery_id": p["discovery_id"], "relevance": 0.9 if "agents" in p["title"] else 0.1, "reason": "by its title"} for p in papers]}
            return {}

    return Provider()


def counts():
    class Counts:
        def lookup(self, keys):
            return [{"paperId": k, "citationCount": 3, "influentialCitationCount": 1, "referenceCount": 2} for k in keys]

    return Counts()


def fresh(spark, tmp_path, name):
    engine = Engine(spark, str(tmp_path / name), provider(str(tmp_path / f"{name}.log")))
    Preferences(engine).set_note("tool agents that recover", NOW.isoformat())
    return engine


def outcome(engine):
    read = engine.store.read
    return {
        "discoveries": sorted(map(tuple, read("discovery_records").select("source_id", "status", "attempts").collect())),
        "lanes": sorted(map(tuple, read("paper_priority_scores").select("discovery_id", "lane", "affinity_score").collect())),
        "counts": sorted(map(tuple, read("discovery_citation_metrics").select("discovery_id", "citation_count").collect())),
        "papers": sorted(map(tuple, read("papers").select("id", "canonical_title").collect())),
        "passages": read("evidence_passages").count(),
        "vectors": read("embeddings").count(),
        "snapshots": sorted(map(tuple, read("snapshots").select("id", "paper_count").collect())),
        "digests": sorted(map(tuple, read("daily_digest_runs").select("id", "status").collect())),
        "steps": sorted(map(tuple, read("workflow_steps").select("step", "inputs").collect())),
    }


def run(engine, catalog=None, budget=4):
    own = DailyRun(engine, catalog or Catalog(), fetcher(), counts())
    # the stand-in writes no article: the run's digest fails its rules, as a step of its own
    own.digest.generate = lambda *a, **k: {"status": "no_new_papers", "run_id": "digest_x"}
    return own.run(CONFIG, NOW, budget=budget, types=("method",))


def test_a_broken_run_ends_as_a_whole_one(spark, tmp_path, monkeypatch):
    whole = fresh(spark, tmp_path, "whole")
    told = run(whole)
    names = ["discover", "discovery citations", "prioritise", "acquire", "citations", "embed", "extract", "snapshot", "digest"]
    assert told["done"] == names and told["skipped"] == [] and told["acquired"] >= 3
    want, asked = outcome(whole), (tmp_path / "whole.log").read_text()
    lanes = {r["lane"] for r in whole.store.read("paper_priority_scores").collect()}
    assert "preference" in lanes and whole.store.read("discovery_relevance").count() == 5 and whole.store.read("discovery_vectors").count() == 5
    # done again, it does nothing
    catalog = Catalog()
    again = run(whole, catalog)
    assert again["done"] == [] and again["skipped"] == names and catalog.calls == 0
    assert outcome(whole) == want and (tmp_path / "whole.log").read_text() == asked

    # one store that breaks after one step after the other, before the step is remembered
    broken, real = fresh(spark, tmp_path, "broken"), Steps.run
    for name in ("discover", "prioritise", "acquire", "extract", "snapshot"):

        def dies(self, step, inputs, action, name=name):
            def once():
                action()
                raise RuntimeError(f"died after {name}")

            return real(self, step, inputs, once if step == name else action)

        monkeypatch.setattr(Steps, "run", dies)
        with pytest.raises(RuntimeError, match=f"died after {name}"):
            run(broken)
        monkeypatch.setattr(Steps, "run", real)
    assert run(broken)["done"] == ["snapshot", "digest"]
    assert outcome(broken) == want
    assert (tmp_path / "broken.log").read_text() == asked

    # another budget is another input: what builds on the selection is done anew, the rest is not
    more = run(broken, budget=5)
    assert more["skipped"][:2] == names[:2] and "prioritise" in more["done"]
    assert broken.store.read("discovery_records").filter(F.col("status") == "acquired").count() == 4
