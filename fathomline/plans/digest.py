"""The daily digest: one run a date, snapshot and client; articles are stored whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.functions.vectors import dot
from fathomline.operators import digest, evidence, fusion
from fathomline.plans.engine import Engine

MOST_CANDIDATES = 40
CLIENTS = ("codex", "claude")


class Digest:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.store, self.spark = engine, engine.store, engine.spark

    # who reads

    def personalisation(self, labels: list[str] = (), *, active: bool = False) -> dict:
        """Terms, themes and favourites that steer a digest; ``labels`` and ``active`` come from the interest profile."""
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), t.clip(F.coalesce("abstract", F.lit("")), 1000).alias("abstract"))
        liked = self.store.read("paper_favorites").join(papers, "paper_id")
        shown = liked.orderBy(F.desc("created_at"), "title").limit(24)
        records = self.store.read("scientific_records").join(shown.select("paper_id"), "paper_id", "left_semi")
        nth = F.row_number().over(Window.partitionBy("paper_id", "record_type").orderBy(F.desc("confidence"), F.desc("created_at"), "id"))
        said = records.withColumn("n", nth).filter("n <= 2").groupBy("paper_id").agg(F.sort_array(F.collect_list(t.clip(F.col("statement"), 320))).alias("statements"))
        rows = shown.join(said, "paper_id", "left").withColumn("statements", F.coalesce("statements", F.array().cast("array<string>")))
        terms = [r["term"] for r in digest.profile_terms(rows, list(labels)).orderBy(F.desc("weight"), "term").collect()]
        themes = self.store.read("daily_blogs").join(shown.select("paper_id"), "paper_id", "left_semi").select(F.explode("themes").alias("theme")).groupBy("theme").count()
        return {
            "active": active or not liked.isEmpty(),
            "top_terms": terms,
            "preference_labels": list(labels),
            "themes": [r["theme"] for r in themes.orderBy(F.desc("count"), "theme").limit(12).collect()],
        }

    def candidates(self, paper_ids: list[str], profile: dict, limit: int = MOST_CANDIDATES) -> DataFrame:
        asked = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paper_ids)], "paper_id string")
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), "abstract", "source_url", "published_date").join(asked, "paper_id", "left_semi")
        own = digest.counted(papers, self.store.read("scientific_records").join(asked, "paper_id", "left_semi"), self.store.read("visual_evidence").join(asked, "paper_id", "left_semi"))
        scored = digest.preference_scores(own.join(self._likeness(asked), "paper_id", "left"), profile["top_terms"], "semantic")
        return digest.candidates(scored, limit, profile["active"]).join(scored, "paper_id").orderBy("position")

    def _likeness(self, asked: DataFrame) -> DataFrame:
        """(paper_id, semantic): the papers' mean vectors against that of all favourites."""
        owner = self.store.read("paper_versions").filter("is_current").select(F.col("id").alias("paper_version_id"), "paper_id")
        vectors = self.store.read("embeddings").filter(F.col("model") == self.engine.model).join(owner, "paper_version_id")
        packed = lambda rows: fusion.centroids(rows, "paper_id", "vector").groupBy(F.col("group").alias("paper_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
        liked = packed(vectors.join(self.store.read("paper_favorites").select("paper_id"), "paper_id", "left_semi"))
        reader = fusion.centroids(liked.withColumn("all", F.lit(1)), "all", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("reader"))
        mine = packed(vectors.join(asked, "paper_id", "left_semi")).crossJoin(F.broadcast(reader))  # one row
        return mine.filter((F.size("v") == F.size("reader")) & (F.size("v") > 0)).select("paper_id", dot(F.col("v"), F.col("reader")).alias("semantic"))

    def daily_papers(self, group: str, snapshot_id: str, client: str, new_papers: list[str]) -> list[str]:
        """What the day's digest may draw from: new papers; else those of the last run unless it is complete; else papers that the group acquired first."""
        if new_papers:
            return list(dict.fromkeys(new_papers))
        last = self.store.read("daily_digest_runs").filter((F.col("snapshot_id") == snapshot_id) & (F.col("client") == client)).orderBy(F.desc("created_at")).limit(1).first()
        if last and last["status"] == "complete":
            return []
        if last and last["status"] in ("running", "failed"):
            return list(dict.fromkeys(last["candidate_ids"]))
        head = self.store.read("ingestion_groups").filter(F.col("id") == group).select(F.col("id").alias("group_id"), F.col("created_at").alias("since"))
        runs = self.store.read("ingestion_group_runs").join(head, "group_id").select("run_id", "since")
        got = self.store.read("discovery_records").filter("status = 'acquired' and paper_id is not null").join(runs, "run_id")
        born = self.store.read("papers").select(F.col("id").alias("paper_id"), "created_at")
        fresh = got.drop("created_at").join(born, "paper_id").filter(F.col("created_at") >= F.col("since"))
        first = fresh.groupBy("paper_id").agg(F.min(F.struct("published_date", "source_id")).alias("at"))
        return [r["paper_id"] for r in first.orderBy("at", "paper_id").collect()]

    # runs

    def _mark(self, run_id: str, **fields) -> None:
        self.store.set("daily_digest_runs", run_id, **fields)

    def generate(self, snapshot_id: str, paper_ids: list[str], client: str, *, run_date: str, now, profile: dict | None = None, most: int = 3) -> dict:
        """Ask the provider for ``most`` articles on the candidates, check every rule and store them with the run.

        ``now`` is a datetime. A complete run of the same day, snapshot and client is answered from the store; a failed one is tried again with its candidates."""
        if client not in CLIENTS:
            raise ValueError("the daily analyst is codex or claude")
        if not 1 <= most <= 3:
            raise ValueError("a digest has 1 to 3 articles")
        run_id = t.stable_key("digest", run_date, snapshot_id, client)
        old = self.store.read("daily_digest_runs").filter(F.col("id") == run_id).first()
        if old and old["status"] == "complete" and not paper_ids:
            return {"status": "already_complete", "run_id": run_id, "blogs": [r.asDict() for r in self.store.read("daily_blogs").filter(F.col("run_id") == run_id).select("id", "slug", "paper_id").orderBy("id").collect()]}
        if old and old["status"] == "failed" and not paper_ids:
            paper_ids = list(old["candidate_ids"])
        profile = profile or self.personalisation()
        chosen = [r.asDict(recursive=True) for r in self.candidates(paper_ids, profile).collect()] if paper_ids else []
        head = {"run_date": run_date, "snapshot_id": snapshot_id, "client": client, "candidate_ids": [c["paper_id"] for c in chosen], "created_at": old["created_at"] if old else now, "error": None}
        if not chosen:
            self._mark(run_id, status="no_new_papers", **head)
            return {"status": "no_new_papers", "run_id": run_id, "blogs": []}
        self._mark(run_id, status="running", **head)
        try:
            wanted = min(most, len(chosen))
            prompt = "digest: " + json.dumps({"snapshot_id": snapshot_id, "articles": wanted, "candidates": chosen, "profile": profile}, sort_keys=True, default=str)
            answer = self.engine.provider.structured(prompt, {"articles": digest.ARTICLE})
            saved = self.store_articles(run_id, answer, [c["paper_id"] for c in chosen], wanted, profile, run_date=run_date, now=now)
        except Exception as error:
            self._mark(run_id, status="failed", error=str(error)[:2000], completed_at=now)
            raise
        return {"status": "complete", "run_id": run_id, "blogs": saved}

    def store_articles(self, run_id: str, answer: dict, candidate_ids: list[str], wanted: int, profile: dict, *, run_date: str, now) -> list[dict]:
        """Store the articles of an answer if all of them keep all rules; the run's former articles go."""
        given = answer.get("articles")
        if not isinstance(given, list) or len(given) != wanted:
            raise ValueError(f"the analyst must return exactly {wanted} articles")
        wrong = evidence.mode_errors([str(a.get("mode", "")) for a in given], bool(profile["active"]))
        if wrong:
            raise ValueError("; ".join(wrong))
        wide = self.spark.createDataFrame([], digest.ARTICLE)
        rows = [tuple(f"article {i + 1}" if c == "article" else a.get(c) for c in wide.columns) for i, a in enumerate(given)]
        articles = self.spark.createDataFrame(rows, wide.schema)
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), "source_url")
        errors = digest.article_errors(
            articles,
            candidates=self.spark.createDataFrame([(c,) for c in candidate_ids], "paper_id string"),
            passages=self.store.read("evidence_passages").select("id", "paper_id"),
            figures=self.store.read("visual_evidence").select("id", "paper_id"),
            papers=papers,
            favourites=self.store.read("paper_favorites").select("paper_id"),
            labels=profile["preference_labels"],
        )
        broken = errors.orderBy("article", "error").collect()
        if broken:
            raise ValueError("; ".join(f"{r['article']}: {r['error']}" for r in broken))
        dates = self.store.read("papers").select(F.col("id").alias("paper_id"), "published_date")
        slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
        named = articles.join(papers, "paper_id").join(dates, "paper_id").withColumns({
            "id": t.stable_id("blog", F.lit(run_id), F.col("paper_id")),
            "run_id": F.lit(run_id),
            "slug": F.concat_ws("-", F.lit(run_date), F.coalesce(F.nullif(F.substring(slug, 1, 60), F.lit("")), F.col("paper_id"))),
            "related_paper_ids": F.col("related_ids"),
            "created_at": F.lit(now),
        })
        stored = self.store.read("daily_blogs")
        gone = stored.filter(F.col("run_id") == run_id).select(F.col("id").alias("blog_id"))
        with self.store.transaction() as change:
            change.replace("daily_blog_personalization", named.select(F.col("id").alias("blog_id"), "mode", "reason", "matched_labels", F.col("matched_favourites").alias("matched_favorites")), gone)
            change.replace("daily_blogs", named.select(*stored.columns), gone.select(F.col("blog_id").alias("id")))
        self._mark(run_id, status="complete", headline=str(answer.get("headline", "")).strip(), synthesis=str(answer.get("synthesis", "")).strip(), trends=[str(x) for x in answer.get("trends", [])], error=None, completed_at=now)
        return [r.asDict() for r in named.select(F.col("id").alias("blog_id"), "slug", "paper_id", "mode", "reason").orderBy("blog_id").collect()]

    # reads

    def blog(self, blog_id: str) -> dict:
        row = self.store.read("daily_blogs").filter(F.col("id") == blog_id).join(self.store.read("daily_blog_personalization").withColumnRenamed("blog_id", "id"), "id", "left").first()
        if row is None:
            raise KeyError(f"Unknown article: {blog_id}")
        return row.asDict(recursive=True)

    def dashboard(self, limit: int = 30) -> dict:
        """The newest runs with their articles, and what the corpus holds."""
        runs = self.store.read("daily_digest_runs").orderBy(F.desc("run_date"), F.desc("created_at")).limit(limit)
        blogs = self.store.read("daily_blogs").groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "slug", "title", "paper_id"))).alias("blogs"))
        return {"corpus": self.engine.corpus_status(), "runs": [r.asDict(recursive=True) for r in runs.join(blogs, "id", "left").orderBy(F.desc("run_date"), F.desc("created_at")).collect()]}
