"""Stored organisation of a snapshot: groups, their labels and members, refined and named by a provider where there is one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.operators import cluster, evidence, ranking
from fathomline.plans.engine import Engine

BATCH = 40  # papers a provider looks at together


def refined(members: DataFrame, papers: DataFrame, provider, *, batch: int = BATCH) -> DataFrame:
    """Members(cluster, paper_id, title, similarity) regrouped by the provider, ``batch`` papers in cluster order at a time: batch, grp, paper_id, similarity, title,
    description, valid. A batch whose answer isn't an exact partition gives one row that isn't valid; the caller then keeps the groups as they were."""
    order = F.row_number().over(Window.orderBy("cluster", "nth")) - 1
    numbered = members.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy("title", "paper_id"))).withColumn("batch", F.floor(order / batch).cast("int"))
    asked = numbered.select("batch", "paper_id").join(papers.select("paper_id", "title", "abstract"), "paper_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, ids, texts in zip(pdf["batch"], pdf["ids"], pdf["texts"], strict=True):
                ids = list(ids)
                try:
                    groups = provider.structured("partition " + json.dumps({"papers": list(texts)}), {"groups": "title, description, shared_problem, paper_ids, membership_confidence"}).get("groups")
                except (RuntimeError, ValueError, OSError):
                    groups = None
                valid = isinstance(groups, list) and bool(groups) and all(isinstance(g, dict) and isinstance(g.get("paper_ids"), list) and g["paper_ids"] for g in groups) and evidence.exact_partition(groups, ids)
                out = [(number, k, p, 1.0 if len(g["paper_ids"]) == 1 else max(0.0, min(1.0, float(g["membership_confidence"]))), " ".join(g["title"].split()).strip(" ."), " ".join(g["description"].split()), True) for k, g in enumerate(groups) for p in g["paper_ids"]] if valid else [(number, 0, None, 0.0, None, None, False)]
                yield pd.DataFrame(out, columns=["batch", "grp", "paper_id", "similarity", "title", "description", "valid"])

    texts = asked.groupBy("batch").agg(F.sort_array(F.collect_list("paper_id")).alias("ids"), F.transform(F.array_sort(F.collect_list(F.struct("paper_id", "title", "abstract"))), lambda x: F.to_json(x)).alias("texts"))
    return texts.mapInPandas(run, "batch int, grp int, paper_id string, similarity double, title string, description string, valid boolean")


def member_order(members: DataFrame) -> DataFrame:
    """Adds ``place``: papers new to the corpus first, then by similarity and title."""
    by = Window.partitionBy("cluster").orderBy(F.desc("is_new"), F.desc("similarity"), "title", "paper_id")
    return members.withColumn("place", F.row_number().over(by))


def cluster_heads(members: DataFrame) -> DataFrame:
    """One row a cluster: size, new papers, mean similarity, title of the first member; ``ordinal`` by size, then the sorted ids of the members."""
    heads = members.groupBy("cluster").agg(F.count(F.lit(1)).cast("int").alias("paper_count"), F.count_if("is_new").cast("int").alias("new_count"), F.round(F.avg("similarity"), 6).alias("average_similarity"), F.min_by("title", "place").alias("first_title"), F.sort_array(F.collect_list("paper_id")).alias("ids"))
    return heads.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("paper_count"), "ids")) - 1).drop("ids")


def short_title(title: str | None, ordinal: int) -> str:
    """A label from a paper's title: no leading article, nine words at most."""
    rest = re.sub(r"(?i)^(?:an?|the)\s+", "", title or "").split()
    cut = " ".join(rest[:9]).rstrip(" ,:;-") + "…" if len(rest) > 9 else re.sub(r"(?i)^(?:an?|the)\s+", "", title or "")
    return cut or f"Research Group {ordinal + 1}"


def usable_labels(answer: dict, ordinals: set[int]) -> dict[int, dict]:
    """Of a provider's labels the ones that fit a cluster: 2 to 10 words, at most 100 characters, no list of keywords, a sentence beside it, none twice."""
    kept: dict[int, dict] = {}
    for item in answer.get("labels", []):
        if not isinstance(item, dict) or not isinstance(item.get("ordinal"), int):
            continue
        title, text = " ".join(str(item.get("title", "")).split()).strip(" ."), " ".join(str(item.get("description", "")).split())
        taken = {x["title"].casefold() for x in kept.values()}
        if item["ordinal"] in ordinals and 2 <= len(title.split()) <= 10 and len(title) <= 100 and "·" not in title and title.casefold() not in taken and text:
            kept[item["ordinal"]] = {"title": title, "description": text}
    return kept


class Organisation:
    def __init__(self, engine: Engine, reader=None) -> None:
        """``reader``: the provider that refines and names groups; None leaves them as they were found."""
        self.engine, self.store, self.spark, self.reader = engine, engine.store, engine.spark, reader

    def build(self, snapshot_id: str, *, run_date: str, now, new_papers: list[str] = (), threshold: float = 0.58, most: int = 48) -> dict:
        """Group the snapshot's papers and store the run; a second run of the day replaces the first."""
        self.engine.snapshot_info(snapshot_id)
        with self.store.scratch() as path:
            self._build(path, snapshot_id, run_date, now, list(new_papers), threshold, most)
        return self.latest(today=run_date)

    def _build(self, path: str, snapshot_id: str, run_date: str, now, new_papers: list[str], threshold: float, most: int) -> None:
        features = self.engine.paper_features(snapshot_id)
        papers = features.select("paper_id", "title", "abstract")
        cluster.leader_clusters(features, threshold=threshold, most=most).join(papers.select("paper_id", "title"), "paper_id").write.parquet(f"{path}/led")
        members, named = self.spark.read.parquet(f"{path}/led"), None
        if self.reader is not None:
            refined(members, papers, self.reader).write.parquet(f"{path}/refined")  # the provider answers once
            answers = self.spark.read.parquet(f"{path}/refined")
            if answers.filter("not valid").isEmpty():
                groups = answers.select("batch", "grp").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("batch", "grp")) - 1)
                joined = answers.join(groups, ["batch", "grp"])
                named = {r["cluster"]: {"title": r["title"], "description": r["description"]} for r in joined.select("cluster", "title", "description").distinct().collect()}
                members = joined.select("paper_id", "cluster", "similarity").join(papers.select("paper_id", "title"), "paper_id")
        new = F.array(*map(F.lit, new_papers)) if new_papers else F.array().cast("array<string>")
        members = member_order(members.withColumn("is_new", F.array_contains(new, F.col("paper_id"))))
        heads = [r.asDict() for r in cluster_heads(members).orderBy("ordinal").collect()]  # a row a group
        terms: dict[int, list] = {}
        for r in cluster.top_terms(members.join(features.select("paper_id", "tokens"), "paper_id").select("cluster", "paper_id", "tokens")).orderBy("cluster", "rank").collect():
            terms.setdefault(r["cluster"], []).append(r["term"])
        labels = self._labels(heads, named or {}, terms, members)
        run_id = t.stable_key("org", run_date, snapshot_id)
        self._store(run_id, run_date, snapshot_id, now, heads, labels, terms, members, {"threshold": threshold, "most": most, "refined": named is not None})

    def _labels(self, heads: list[dict], named: dict[int, dict], terms: dict[int, list], members: DataFrame) -> list[dict]:
        made: dict[int, dict] = {}
        open_heads = [h for h in heads if h["cluster"] not in named]
        if self.reader is not None and open_heads:
            titles: dict[int, list] = {}
            for r in members.filter("place <= 8").orderBy("cluster", "place").select("cluster", "title").collect():
                titles.setdefault(r["cluster"], []).append(r["title"])
            try:
                answer = self.reader.structured("label " + json.dumps([{"ordinal": h["ordinal"], "paper_count": h["paper_count"], "terms": terms.get(h["cluster"], []), "titles": titles[h["cluster"]]} for h in open_heads]), {"labels": "ordinal, title, description"})
            except (RuntimeError, ValueError, OSError):
                answer = {}
            made = usable_labels(answer, {h["ordinal"] for h in open_heads})
        used: set[str] = set()
        out = []
        for h in heads:
            own = named.get(h["cluster"]) or made.get(h["ordinal"]) or {}
            plain = short_title(h["first_title"], h["ordinal"])
            label = next((x for x in (own.get("title"), plain) if x and x.casefold() not in used), f"{plain} ({h['ordinal'] + 1})")
            used.add(label.casefold())
            out.append({"label": label, "description": own.get("description")})
        return out

    def _store(self, run_id, run_date, snapshot_id, now, heads, labels, terms, members, configuration) -> None:
        runs, clusters = self.store.read("organization_runs"), self.store.read("paper_clusters")
        old = clusters.filter(F.col("run_id") == run_id).select(F.col("id").alias("cluster_id"))
        ids = {h["cluster"]: t.stable_key("cluster", run_id, h["ordinal"]) for h in heads}
        rows = [(ids[h["cluster"]], run_id, h["ordinal"], x["label"], x["description"], terms.get(h["cluster"], []), h["paper_count"], h["new_count"], h["average_similarity"]) for h, x in zip(heads, labels, strict=True)]
        tagged = members.join(self.spark.createDataFrame(list(ids.items()), "cluster int, cluster_id string"), "cluster").select("cluster_id", "paper_id", "similarity", "is_new")
        head = self.spark.createDataFrame([(run_id, run_date, snapshot_id, "leader", self.engine.model, "complete", json.dumps(configuration, sort_keys=True), json.dumps({"groups": len(heads)}), now)], runs.schema)
        with self.store.transaction() as change:
            change.replace("paper_cluster_members", tagged, old)
            change.replace("paper_clusters", self.spark.createDataFrame(rows, clusters.schema), old.withColumnRenamed("cluster_id", "id"))
            change.upsert("organization_runs", head)

    def latest(self, *, today: str, positive: list[str] = (), negative: list[str] = (), active: bool = False) -> dict:
        """The newest run's groups, their papers ranked anew; ``{"status": "not_ready"}`` where none is stored."""
        run = self.store.read("organization_runs").orderBy(F.desc("run_date"), F.desc("created_at")).limit(1).first()
        if run is None:
            return {"status": "not_ready", "groups": []}
        clusters = self.store.read("paper_clusters").filter(F.col("run_id") == run["id"])
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), "published_date")
        counts = self.store.read("paper_citation_metrics").groupBy("paper_id").agg(F.max("citation_count").alias("citation_count"))
        rows = self.store.read("paper_cluster_members").join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").join(papers, "paper_id").join(counts, "paper_id", "left")
        ranked = ranking.ranked_groups(rows, today=today, positive=list(positive), negative=list(negative), active=active, groups=["cluster_id"])
        packed = ranked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("position", "paper_id", "title", "score", "reasons", "is_new", "similarity"))).alias("papers"))
        found = clusters.withColumnRenamed("id", "cluster_id").join(packed, "cluster_id", "left").orderBy(F.desc("paper_count"), "label")
        groups = [r.asDict(recursive=True) for r in found.drop("run_id").collect()]
        return {"status": "ready", "run_id": run["id"], "run_date": run["run_date"], "snapshot_id": run["snapshot_id"], "groups": groups}
