"""The daily run as steps that are remembered: discover, count citations, prioritise, acquire, enrich, pin a snapshot, write the digest.

A step is known by its workflow, its name and its inputs (what was asked for, and the results of the steps before that it builds on). One that is stored with the same inputs is not done again; a step
whose inputs have changed is, and so are those that build on it. Each step can be repeated itself, so that a run that breaks anywhere ends as one that did not."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import functions as F

from fathomline.functions.text import stable_key
from fathomline.plans.digest import Digest
from fathomline.plans.engine import Engine
from fathomline.plans.extraction import TYPES, extract
from fathomline.plans.ingestion import Harvest, Ingestion
from fathomline.plans.preferences import Preferences


class Steps:
    """Steps of one workflow; ``done`` and ``skipped`` name those of this run."""

    def __init__(self, engine: Engine, workflow: str) -> None:
        self.engine, self.store, self.workflow = engine, engine.store, workflow
        self.done: list[str] = []
        self.skipped: list[str] = []

    def stored(self) -> dict[str, tuple[str, dict]]:
        rows = self.store.read("workflow_steps").filter(F.col("workflow") == self.workflow).collect()
        return {r["step"]: (r["inputs"], json.loads(r["result"])) for r in rows}

    def run(self, step: str, inputs: dict, action: Callable[[], dict]) -> dict:
        key = stable_key("inputs", json.dumps(inputs, sort_keys=True, default=str))
        known = self.stored().get(step)
        if known and known[0] == key:
            self.skipped.append(step)
            return known[1]
        # the form that a later run reads is the form that this one goes on with
        result = json.loads(json.dumps(action(), default=str))
        spark = self.engine.spark
        row = spark.range(1).select(F.lit(self.workflow).alias("workflow"), F.lit(step).alias("step"), F.lit(key).alias("inputs"), F.lit(json.dumps(result)).alias("result"), F.current_timestamp().alias("finished_at"))
        self.store.upsert("workflow_steps", row)
        self.done.append(step)
        return result


class DailyRun:
    """services: ``client`` (catalog pages), ``fetch`` (a record's text), ``citations`` (or None); the engine's provider embeds, extracts and writes."""

    def __init__(self, engine: Engine, client, fetch, citations=None) -> None:
        self.engine, self.fetch, self.citations = engine, fetch, citations
        self.flow, self.preferences, self.digest = Ingestion(engine, client), Preferences(engine), Digest(engine)

    def run(self, config: Harvest, now: datetime, *, budget: int = 40, analyst: str = "claude", types: tuple[str, ...] = TYPES, primary_only: bool = True, articles: int = 3) -> dict:
        at = now.isoformat()
        asked = asdict(config) | {"day": at[:10]}
        steps = Steps(self.engine, stable_key("daily", json.dumps(asked, sort_keys=True), analyst))
        group = steps.run("discover", asked, lambda: self._kept(self.flow.discover_monthly(config), "id", "discovered", "runs"))["id"]
        if self.citations is not None:
            steps.run("discovery citations", {"group": group}, lambda: self.flow.refresh_discovery_citations(group, self.citations, at))
        # what the reader wants by now is an input: a new profile makes a new selection
        profile = self.preferences.current_profile(at, persist=True)["profile_version_id"]
        chosen = steps.run("prioritise", {"group": group, "budget": budget, "profile": profile}, lambda: self._chosen(group, budget, at, primary_only))
        got = steps.run("acquire", {"group": group, "chosen": chosen["selected_discovery_ids"]}, lambda: self._acquired(group, chosen["selected_discovery_ids"], primary_only))
        if self.citations is not None:
            steps.run("citations", {"papers": got["acquired"], "group": group}, lambda: self.flow.refresh_citations(self.citations, at))
        steps.run("embed", got, self.engine.enrich)
        steps.run("extract", got | {"types": types}, lambda: extract(self.engine, types=types, skip_completed=True))
        snapshot = f"daily-{at[:10]}-{stable_key('s', group, str(got))[-8:]}"
        pinned = steps.run("snapshot", {"snapshot": snapshot}, lambda: self._kept(self.engine.create_snapshot(snapshot, start=config.start, end=config.end, now=at), "snapshot_id", "paper_count"))
        papers = self.digest.daily_papers(group, snapshot, analyst, got["paper_ids"])
        told = steps.run("digest", {"snapshot": snapshot, "papers": papers, "articles": articles}, lambda: self._kept(self.digest.generate(snapshot, papers, analyst, run_date=at[:10], now=now, most=articles), "status", "run_id"))
        return {"workflow": steps.workflow, "group": group, "selected": chosen["lane_counts"], "acquired": got["acquired"], "failed": got["failed"], "snapshot": pinned["snapshot_id"], "digest": told["status"], "done": steps.done, "skipped": steps.skipped}

    @staticmethod
    def _kept(result: dict, *names: str) -> dict:
        return {n: result.get(n) for n in names}

    def _chosen(self, group: str, budget: int, at: str, primary_only: bool) -> dict:
        """An earlier run's selection where it had begun to acquire it, else a new one."""
        found = self.preferences.resumed(group, at) or self.preferences.prioritise(group, budget, at, primary_only=primary_only)
        return self._kept(found, "selected_discovery_ids", "lane_counts")

    def _acquired(self, group: str, ids: list[str], primary_only: bool) -> dict:
        """Told from what is stored, so that a step that died after it had acquired gives the same."""
        if not ids:
            return {"acquired": 0, "failed": 0, "paper_ids": []}
        self.flow.acquire_group(group, self.fetch, ids=ids, primary_only=primary_only)
        rows = self.preferences._group_rows(group).filter(F.col("id").isin(ids)).select("status", "paper_id").orderBy("published_date", "source_id").collect()
        return {"acquired": sum(r["status"] == "acquired" for r in rows), "failed": sum(r["status"] == "failed" for r in rows), "paper_ids": list(dict.fromkeys(r["paper_id"] for r in rows if r["status"] == "acquired"))}
