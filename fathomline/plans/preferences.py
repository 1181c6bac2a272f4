"""The preference workflow over the store: sources under the reader's control, incremental sync, the explicit note, profiles, priorities."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import stable_id
from fathomline.functions.vectors import cosine
from fathomline.operators import history, profile, relevance
from fathomline.plans.engine import Engine
from fathomline.providers import embed_rows

# Sources and kinds that are known.
SOURCES = ["claude", "codex"]
KINDS = ["topic", "problem", "method", "artifact", "positive", "negative"]
NOTE_SESSION = "dashboard_explicit_current"
LONGEST_NOTE = 12_000


def valid_events(events: DataFrame, most: int = 24) -> DataFrame:
    """Extracted events of known kind and explicitness with a label and a number as confidence: the first ``most`` of a session, one of each (kind, label)."""
    from pyspark.sql import Window

    ok = events.filter(F.col("kind").isin(KINDS) & F.col("explicitness").isin("explicit", "inferred") & (F.trim("label") != "") & F.col("confidence").isNotNull())
    ok = ok.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))))
    first = F.row_number().over(Window.partitionBy("session_fingerprint", "kind", F.lower("label")).orderBy("nth"))
    nth = F.row_number().over(Window.partitionBy("session_fingerprint").orderBy("nth"))
    return ok.withColumn("__f", first).filter("__f = 1").withColumn("__n", nth).filter(F.col("__n") <= most).drop("__f", "__n")


class Preferences:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.spark, self.store = engine, engine.spark, engine.store

    def configure(self, enabled: list[str], now: str) -> None:
        """Exactly these sources are on; consent keeps the time it was first given."""
        if set(enabled) - set(SOURCES):
            raise ValueError(f"Unknown preference source: {', '.join(sorted(set(enabled) - set(SOURCES)))}")
        stored = self.store.read("preference_sources")
        at = F.lit(now).cast("timestamp")
        wanted = self.spark.createDataFrame([(s, s in enabled) for s in SOURCES], "source string, on boolean").join(stored.select("source", F.col("consented_at").alias("c")), "source", "left")
        rows = wanted.select("source", F.col("on").alias("enabled"), F.coalesce("c", F.when(F.col("on"), at)).alias("consented_at"), at.alias("updated_at"))
        self.store.upsert("preference_sources", rows)

    def disable(self, source: str, now: str) -> None:
        """Nothing new is read; what was learned stays."""
        stored = self.store.read("preference_sources")
        self.store.upsert("preference_sources", stored.withColumn("enabled", F.when(F.col("source") == source, False).otherwise(F.col("enabled"))).withColumn("updated_at", F.lit(now).cast("timestamp")))

    def forget(self, source: str) -> None:
        """The source's sessions go, and their events with them."""
        sessions = self.store.read("preference_sessions")
        gone = sessions.filter(F.col("source") == source).select(F.col("fingerprint").alias("session_fingerprint"))
        with self.store.transaction() as change:
            change.delete("preference_events", gone)
            change.delete("preference_sessions", gone.select(F.col("session_fingerprint").alias("fingerprint")))

    def sync(self, turns: DataFrame, extract, now: str) -> dict:
        """turns(source, session, turn, role, text, observed_at): sessions of enabled sources whose text has changed are extracted anew.

        extract: DataFrame of turns -> DataFrame (session_fingerprint, nth, kind, label, context, confidence, explicitness)."""
        on = self.store.read("preference_sources").filter("enabled").select("source")
        own = history.user_turns(turns.join(on, "source", "left_semi").withColumn("session_fingerprint", stable_id("s", F.col("source"), F.col("session"))), "session_fingerprint", "turn").filter(history.about_research(F.col("text")))
        own = history.within_budget(own, "session_fingerprint", "turn")
        digests = own.groupBy("session_fingerprint", "source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("content_digest"), F.max(F.col("observed_at").cast("timestamp")).alias("observed_at"), F.count(F.lit(1)).cast("int").alias("turn_count"))
        stored = self.store.read("preference_sessions")
        changed = digests.join(stored.select(F.col("fingerprint").alias("session_fingerprint"), "content_digest"), ["session_fingerprint", "content_digest"], "left_anti").persist()
        n = changed.count()
        if n:
            events = valid_events(extract(own.join(changed.select("session_fingerprint"), "session_fingerprint", "left_semi"))).join(changed.select("session_fingerprint", "source", "observed_at"), "session_fingerprint")
            sessions = changed.select(F.col("session_fingerprint").alias("fingerprint"), "source", "content_digest", "observed_at", "turn_count", F.lit("processed").alias("status"), F.lit(now).cast("timestamp").alias("processed_at"))
            with self.store.transaction() as change:
                change.replace("preference_events", self._event_rows(events, now), changed.select("session_fingerprint"))
                change.upsert("preference_sessions", sessions)
        changed.unpersist()
        return {"changed_sessions": n}

    @staticmethod
    def _event_rows(events: DataFrame, now: str) -> DataFrame:
        return events.select(stable_id("pref", F.col("session_fingerprint"), F.col("kind"), F.lower("label")).alias("id"), "source", "session_fingerprint", "kind", "label", "context", "confidence", "explicitness", "observed_at", F.lit(now).cast("timestamp").alias("created_at"))

    def set_note(self, text: str, now: str, extract=None) -> dict:
        """The reader's own words. States: empty, ready, or pending where the model failed and plain parts of the note stand in."""
        note = text.strip()
        if len(note) > LONGEST_NOTE:
            raise ValueError(f"interest text must be at most {LONGEST_NOTE} characters")
        one = self.spark.createDataFrame([(NOTE_SESSION, note)], "session_fingerprint string, text string")
        plain = history.stated_interests(one, "text", "session_fingerprint").select("session_fingerprint", "nth", "kind", "label", F.lit("Explicit dashboard research-interest note.").alias("context"), F.lit(1.0).alias("confidence"), F.lit("explicit").alias("explicitness"))
        status, events = ("ready", None) if note else ("empty", None)
        if note:
            try:
                events = valid_events(extract(one)).withColumn("explicitness", F.lit("explicit")) if extract else None
                if events is None:
                    raise RuntimeError("no model")
                if events.isEmpty():
                    events = plain
            except Exception:  # noqa: BLE001  whatever the model does, the note counts
                status, events = "pending", plain
        rows = (events if note else plain.limit(0)).withColumn("source", F.lit(profile.EXPLICIT_SOURCE)).withColumn("observed_at", F.lit(now).cast("timestamp"))
        head = self.spark.range(1).select(F.lit(1).alias("singleton"), F.lit(note).alias("text"), F.lit(status).alias("extraction_status"), F.lit(now).cast("timestamp").alias("updated_at"))
        with self.store.transaction() as change:
            change.replace("preference_events", self._event_rows(rows, now), one.select("session_fingerprint"))
            change.upsert("explicit_interest_profile", head)
        return {"status": status, "events": self.store.read("preference_events").filter(F.col("session_fingerprint") == NOTE_SESSION).count()}

    def current_profile(self, now: str, *, persist: bool = False) -> dict:
        """The profile by content: the same signals give the same version."""
        events = self.store.read("preference_events")
        liked = self.store.read("papers").join(self.store.read("paper_favorites").select(F.col("paper_id").alias("id")), "id", "left_semi").select(F.col("canonical_title").alias("title"), "abstract")
        note = self.store.read("explicit_interest_profile").first()
        rows = profile.top_concepts(profile.label_weights(events, liked, F.lit(now))).orderBy(F.col("source") != "explicit", F.abs("weight").desc(), F.lower("label")).collect()
        out = profile.activation(events, liked, bool(note and note["text"])).first().asDict()
        out["concepts"] = [{k: r[k] for k in ("label", "weight", "polarity", "source")} for r in rows if r["concept"]]
        for polarity in ("positive", "negative"):
            out[f"{polarity}_labels"] = [r["label"] for r in rows if r["kept"] and r["polarity"] == polarity]
        import hashlib

        body = json.dumps(out, sort_keys=True, separators=(",", ":"))
        version = "profile_" + hashlib.sha256(body.encode()).hexdigest()[:20]
        if persist:
            one = self.spark.range(1).select(F.lit(version).alias("id"), F.lit(body).alias("summary"), F.lit(out["active_for_ingestion"]).alias("active_for_ingestion"), F.lit(now).cast("timestamp").alias("created_at"))
            self.store.upsert("preference_profile_versions", one, how="first")
        return out | {"profile_version_id": version}

    def _group_rows(self, group: str) -> DataFrame:
        links = self.store.read("ingestion_group_runs").filter(F.col("group_id") == group).select("run_id")
        return self.store.read("discovery_records").join(links, "run_id", "left_semi")

    def _semantic(self, rows: DataFrame, positive: list[str], now: str) -> DataFrame | None:
        """(id, semantic): how near each discovery is to the profile's labels, 0 at least; None where the model fails. Texts that have a vector of this model are not embedded again."""
        provider, model = self.engine.provider, self.engine.model
        if provider is None or not positive:
            return None
        try:
            mine = provider.embed(["; ".join(positive)])[0]
            known = self.store.read("discovery_vectors").filter(F.col("model") == model)
            missing = rows.join(known.select(F.col("discovery_id").alias("id")), "id", "left_anti")
            texts = missing.select("id", F.concat_ws("\n", "title", F.coalesce("abstract", F.lit(""))).alias("text"))
            with self.store.scratch() as path:
                embed_rows(texts, provider, "id", "text", batch=64).write.parquet(path)
                fresh = self.spark.read.parquet(path).select(F.col("record_id").alias("discovery_id"), F.lit(model).alias("model"), "vector", F.lit(now).cast("timestamp").alias("created_at"))
                if not fresh.isEmpty():
                    self.store.append("discovery_vectors", fresh)
        except Exception:  # noqa: BLE001  whatever the model does, the words count
            return None
        near = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in mine]), mismatch=0.0)
        return self.store.read("discovery_vectors").filter(F.col("model") == model).select(F.col("discovery_id").alias("id"), F.greatest(F.lit(0.0), near).alias("semantic"))

    def _judged(self, rows: DataFrame, own: dict, now: str) -> DataFrame:
        """(id, relevance) by the model for this profile; only rows without an answer are asked about."""
        model = self.engine.model
        mine = (F.col("profile_version_id") == own["profile_version_id"]) & (F.col("model") == model)
        known = self.store.read("discovery_relevance").filter(mine).select(F.col("discovery_id").alias("id"))
        missing = rows.join(known, "id", "left_anti")
        with self.store.scratch() as path:
            relevance.judged(missing, self.engine.provider, own["positive_labels"], own["negative_labels"]).write.parquet(path)
            fresh = self.spark.read.parquet(path)
            if not fresh.isEmpty():
                tags = [F.lit(own["profile_version_id"]).alias("profile_version_id"), F.lit(model).alias("model"), F.lit(now).cast("timestamp").alias("created_at")]
                self.store.append("discovery_relevance", fresh.select(F.col("id").alias("discovery_id"), "relevance", "reason", *tags))
        return self.store.read("discovery_relevance").filter(mine).select(F.col("discovery_id").alias("id"), "relevance")

    def prioritise(self, group: str, budget: int, now: str, *, primary_only: bool = True, shares: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> dict:
        """Score the group's open discoveries by words, vectors and the model, fill the lanes and keep all scores."""
        own = self.current_profile(now, persist=True)
        head = self.store.read("ingestion_groups").filter(F.col("id") == group).first()
        rows = self._group_rows(group).filter(F.col("status").isin("discovered", "failed"))
        if primary_only and head:
            rows = rows.filter(F.col("primary_category") == head["category"])
        counts = self.store.read("discovery_citation_metrics").filter("provider = 'semantic_scholar'").select(F.col("discovery_id").alias("id"), "citation_count")
        words = [w for label in own["positive_labels"] for w in _tokens(label)]
        active = own["active_for_ingestion"]
        signals, names = rows.join(counts, "id", "left"), {}
        if (near := self._semantic(rows, own["positive_labels"], now)) is not None:
            signals, names["semantic"] = signals.join(near, "id", "left"), "semantic"
        if active and self.engine.provider is not None:
            signals, names["model"] = signals.join(self._judged(rows, own, now), "id", "left"), "relevance"
        with self.store.scratch() as path:
            profile.priority_scores(signals, words, now[:10], **names).write.parquet(path)  # read once for each lane
            scores = self.spark.read.parquet(path)
            lanes = profile.lanes(scores, budget, shares=shares, active=active)
            why = F.when(F.col("lane") == "preference", "Matches the research profile").when(F.col("lane") == "frontier", "Trending or unusually novel within today's paper surplus").when(F.col("lane") == "exploration", "Deliberately broadens the current research profile").when(F.col("lane") == "deferred", "Retained as lightweight metadata for possible future promotion").otherwise("Selected by broad editorial ranking")
            kept = lanes.select(F.col("id").alias("discovery_id"), F.lit(own["profile_version_id"]).alias("profile_version_id"), F.col("affinity").alias("affinity_score"), F.col("frontier").alias("frontier_score"), F.col("exploration").alias("exploration_score"), "final_score", "lane", why.alias("explanation"), F.lit(now).cast("timestamp").alias("created_at"))
            # all scores of a profile are of one moment, whatever an earlier run left
            gone = self._group_rows(group).select(F.col("id").alias("discovery_id"), F.lit(own["profile_version_id"]).alias("profile_version_id"))
            self.store.replace("paper_priority_scores", kept, gone)
        return self._selection(group, own["profile_version_id"]) | {"profile": own, "budget": budget}

    def selected(self, group: str, version: str) -> DataFrame:
        """(discovery_id, lane, final_score, status) of what a profile selected from a group, the best first."""
        scores = self.store.read("paper_priority_scores").filter((F.col("profile_version_id") == version) & (F.col("lane") != "deferred"))
        rows = self._group_rows(group).select(F.col("id").alias("discovery_id"), "status")
        return scores.join(rows, "discovery_id").select("discovery_id", "lane", "final_score", "status").orderBy(F.desc("final_score"), "discovery_id")

    def _selection(self, group: str, version: str) -> dict:
        """Identifiers up to 10,000 (all are in :meth:`selected`), and the counts of all."""
        own = self.selected(group, version)
        counts = {r["lane"]: r["count"] for r in own.groupBy("lane").count().collect()}
        return {"selected_discovery_ids": [r["discovery_id"] for r in own.limit(10_000).collect()], "lane_counts": counts, "selected_count": sum(counts.values())}

    def resumed(self, group: str, now: str) -> dict | None:
        """The selection of an earlier run of the group that broke off after it had acquired something; None where there is none to go on with."""
        rows = self._group_rows(group).select(F.col("id").alias("discovery_id"), "status")
        mine = self.store.read("paper_priority_scores").join(rows, "discovery_id")
        last = mine.filter("lane <> 'deferred'").orderBy(F.desc("created_at"), "profile_version_id").select("profile_version_id").first()
        if last is None:
            return None
        version = last["profile_version_id"]
        if self.selected(group, version).filter("status = 'acquired'").isEmpty():
            return None
        out = self._selection(group, version)
        return out | {"profile": self.current_profile(now, persist=True), "candidate_count": mine.filter(F.col("profile_version_id") == version).count(), "budget": out["selected_count"], "resumed": True}


def _tokens(label: str) -> list[str]:
    import re

    from fathomline.functions.text import PROFILE_STOP

    return [w for w in re.findall(r"[a-z][a-z0-9-]{2,}", label.lower()) if w not in PROFILE_STOP]
