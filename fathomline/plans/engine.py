"""The engine's facade: ingestion, snapshots, evidence search and the read-only tools, over a store of Parquet tables.

Answers are envelopes of at most a hundred rows (records: 500) with coverage, provenance and warnings; all work on tables is declared as DataFrames."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as t
from fathomline.functions.porter import query_phrases, stems
from fathomline.functions.vectors import folded
from fathomline.operators import catalog, cluster, evidence, fusion, lexical, parse, postings, upsert
from fathomline.providers import IntelligenceProvider, embed_rows
from fathomline.sources import files
from fathomline.sources.tables import Store


#: Weights of a passage's fields in a search.
PASSAGE_FIELDS = {"title": 5, "abstract": 3, "section": 2, "text": 1}
#: Segments of the passage index that are searched side by side before the small ones are packed.
MOST_SEGMENTS = 8


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: IntelligenceProvider | None = None, model: str = "hash", analyzer=stems) -> None:
        self.spark, self.store, self.provider, self.model, self.analyzer = spark, Store(spark, root), provider, model, analyzer

    # ingestion

    def ingest(self, texts: DataFrame, *, now: str | None = None) -> dict:
        """texts(title, text, authors, abstract, published_date, source_url, source_class) -> papers, versions, sections and passages.

        A column ``pages`` (array of page and text) takes the place of ``text`` where there is one; ``content_hash`` and ``artifact_uri`` are then the file's.
        Rows with the same title are one paper; a content that a paper has already is left alone; new content becomes its current version."""
        at = F.lit(now or datetime.now(UTC).isoformat()).cast("timestamp")
        normal = t.normal_title(F.col("title"))
        if "pages" not in texts.columns:
            texts = texts.withColumns({"pages": F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"))), "content_hash": F.sha2("text", 256), "artifact_uri": F.lit(None).cast("string")})
        own = texts.withColumn("normalized_title", normal).withColumn("paper_id", t.stable_id("paper", normal))
        own = own.withColumn("version_id", t.stable_id("version", F.col("paper_id"), F.col("content_hash"))).dropDuplicates(["version_id"])
        versions, papers = self.store.read("paper_versions"), self.store.read("papers")
        fresh = own.join(versions.select(F.col("id").alias("version_id")), "version_id", "left_anti").persist()
        added = fresh.count()
        if not added:
            self.refresh_index()
            return {"status": "already_ingested", "versions": 0}
        incoming = fresh.select(F.col("paper_id").alias("id"), F.col("title").alias("canonical_title"), "normalized_title", "abstract", "authors", "published_date", "source_url", "source_class", at.alias("created_at"))
        new = fresh.select(F.col("version_id").alias("id"), "paper_id", "content_hash", "artifact_uri", at.alias("acquired_at"), F.lit(True).alias("is_current"))
        both = versions.join(new.select("paper_id").distinct(), "paper_id", "left_semi").unionByName(new)
        touched = upsert.flip_current(both, order=[F.desc("acquired_at"), F.desc("id")])
        pages = fresh.select(F.col("version_id").alias("id"), F.inline("pages"))
        sections = parse.sections(pages)
        rows = parse.evidence_rows(sections, F.col("id")).join(fresh.select("version_id", "paper_id"), "version_id").persist()
        section_rows = sections.select(t.stable_id("sec", F.col("id"), F.col("ordinal"), F.col("heading")).alias("id"), F.col("id").alias("paper_version_id"), "heading", F.col("ordinal").cast("int").alias("ordinal"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), "text")
        passages = rows.select(F.col("evidence_id").alias("id"), "paper_id", F.col("version_id").alias("paper_version_id"), "section_id", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), F.array("heading").alias("section_path"), "text", "content_hash", F.lit(1.0).alias("extraction_confidence"), at.alias("created_at"))
        figures = parse.captions(pages).select(F.col("id").alias("version"), "page", "label", "caption").join(fresh.select(F.col("version_id").alias("version"), "paper_id"), "version")
        near = parse.nearby(figures, passages.select(F.col("paper_version_id").alias("version"), F.col("id").alias("evidence_id"), "page_start", "page_end", "text"))
        visual = near.select(t.stable_id("fig", F.col("version"), F.col("page"), F.col("label")).alias("id"), "paper_id", F.col("version").alias("paper_version_id"), F.col("page").alias("page_number"), "label", "caption", F.lit(None).cast("string").alias("artifact_uri"), F.sha2("caption", 256).alias("content_hash"), F.lit("caption").alias("artifact_kind"), "nearby_evidence_ids", F.lit("text").alias("extraction_method"), at.alias("created_at"))
        with self.store.transaction() as change:
            change.upsert("papers", incoming, how="fill", fill=["abstract", "authors", "published_date"])
            change.upsert("paper_versions", touched)
            change.append("sections", section_rows)
            change.append("evidence_passages", passages)
            change.append("visual_evidence", visual)  # the identifier holds version, page and label
        fresh.unpersist(), rows.unpersist()
        self.refresh_index()
        return {"status": "ingested", "versions": added}

    def ingest_pdfs(self, path: str, extract, *, about: DataFrame | None = None, now: str | None = None) -> dict:
        """All PDF files below ``path``: each is stored by its content and taken in page by page; a file that fails is told of and stops no other.

        extract(bytes) -> (page, text) pairs. about(uri, title, authors, abstract, published_date, source_url, source_class): what is known of a file by the end of its
        path; elsewhere its name is the title."""
        found = files.artifacts(self.spark, path).select("uri", "content")
        with self.store.scratch() as at:
            files.pdf_pages(found, extract).write.parquet(at)  # files are read by the extractor once
            read = self.spark.read.parquet(at)
            good = read.filter("error is null")
            urls = files.put_artifacts(found.join(good.select("uri"), "uri", "left_semi").select("content"), f"{self.store.root}/_artifacts", "raw")
            named = good.join(urls, "content_hash")
            stem = F.regexp_extract("uri", r"([^/]+?)(?:\.[Pp][Dd][Ff])?$", 1)
            plain = {"title": stem, "authors": F.array().cast("array<string>"), "abstract": F.lit(""), "published_date": F.lit(None).cast("string"), "source_url": F.col("uri"), "source_class": F.lit("preprint")}
            if about is not None:
                known = about.select(F.regexp_extract("uri", r"([^/]+)$", 1).alias("file"), F.struct(*plain).alias("k"))
                named = named.withColumn("file", F.regexp_extract("uri", r"([^/]+)$", 1)).join(known, "file", "left")
                plain = {c: F.coalesce(F.col(f"k.{c}"), v) for c, v in plain.items()}
            out = self.ingest(named.select("pages", "content_hash", "artifact_uri", *[v.alias(c) for c, v in plain.items()]), now=now)
            broken = [r.asDict() for r in read.filter("error is not null").select("uri", "error").orderBy("uri").limit(1000).collect()]
        return out | {"failed": broken}

    def passage_index(self) -> postings.LexicalIndex:
        """The stored index of all passages ever taken in, with their papers' titles and abstracts as they were then."""
        layout = postings.Layout(tuple(PASSAGE_FIELDS), ("paper_id", "paper_version_id", "source_class"))
        return postings.LexicalIndex(self.spark, f"{self.store.root}/_index/passages", layout, id="evidence_id", analyzer=self.analyzer)

    def refresh_index(self) -> int:
        """Index the passages that the store's commits have brought since the index last looked; an ingestion that died in between is made up for."""
        index = self.passage_index()
        since = index.log.state().settings.get("upto", 0)
        rows, upto = self.store.changes("evidence_passages", since)
        if rows is None:
            return 0
        own = self._with_papers(rows)
        added = index.add(own, name=f"passages {since + 1} to {upto}", settings={"upto": upto})["documents"]
        if index.statistics()["segments"] > MOST_SEGMENTS:
            index.merge()
        return added

    def enrich(self) -> dict:
        """Embed the passages that have no vector of this model yet."""
        stored = self.store.read("embeddings")
        passages = self.store.read("evidence_passages")
        missing = passages.join(stored.filter(F.col("model") == self.model).select(F.col("record_id").alias("id")), "id", "left_anti")
        vectors = embed_rows(missing, self.provider, "id", "text").join(missing.select(F.col("id").alias("record_id"), "paper_version_id"), "record_id")
        new = vectors.select("record_id", "paper_version_id", F.lit(self.model).alias("model"), F.size("vector").alias("dimensions"), "vector", F.current_timestamp().alias("created_at"))
        before = stored.count()
        self.store.append("embeddings", new)
        return {"embedded": self.store.read("embeddings").count() - before}

    def add_records(self, records: DataFrame) -> dict:
        """Structured records (record_type, paper_version_id, statement, evidence_ids, numeric_values, confidence, title) that cite only real evidence; others are refused."""
        passages = self.store.read("evidence_passages")
        named = records.withColumn("record_id", t.stable_id("rec", F.col("paper_version_id"), F.col("record_type"), F.col("statement"), F.array_join(F.sort_array(F.array_distinct("evidence_ids")), ",")))
        good = evidence.valid_records(named, passages.select(F.col("id").alias("evidence_id"), "paper_version_id", "text")).dropDuplicates(["record_id"])
        owner = self.store.read("paper_versions").select(F.col("id").alias("paper_version_id"), "paper_id")
        rows = good.join(owner, "paper_version_id").select(F.col("record_id").alias("id"), "paper_id", "paper_version_id", "record_type", "title", "statement", F.array().cast("array<string>").alias("conditions"), "numeric_values", "confidence", F.lit(self.model).alias("extractor_version"), F.current_timestamp().alias("created_at")).persist()
        links = good.select("record_id", F.explode("evidence_ids").alias("evidence_id"), F.lit("supports").alias("relation")).persist()
        n, total = rows.count(), records.count()
        links.count()
        with self.store.transaction() as change:
            change.append("scientific_records", rows)
            change.append("record_evidence", links)
        return {"stored": n, "refused": total - n}

    def add_discoveries(self, rows: DataFrame) -> None:
        """Catalog rows: known ones keep status, date and attempts; new ones take over what was acquired before."""
        stored = self.store.read("discovery_records")
        carried = upsert.carry_over(rows, stored)
        self.store.upsert("discovery_records", carried.select(stored.columns), how="fill", fill=["title", "abstract", "authors", "categories", "updated_at", "abstract_url", "pdf_url"])

    # snapshots

    def create_snapshot(self, snapshot_id: str, *, start: str | None = None, end: str | None = None, synthetic: bool = False, category: str | None = None, primary_only: bool = False, now: str | None = None) -> dict:
        if not catalog.SNAPSHOT_ID.fullmatch(snapshot_id):
            raise ValueError("Snapshot ID may contain letters, numbers, dots, dashes, and underscores")
        members = catalog.snapshot_members(self.store.read("papers"), self.store.read("paper_versions"), start=start, end=end, synthetic=synthetic, discoveries=self.store.read("discovery_records"), category=category, primary_only=primary_only)
        heads, pinned = self.store.read("snapshots"), self.store.read("snapshot_papers")
        old = heads.filter(F.col("id") == snapshot_id).first()
        if old:
            if (old["from_date"], old["to_date"]) == (start, end) and upsert.same_members(pinned.filter(F.col("snapshot_id") == snapshot_id), members, ["paper_id", "paper_version_id"]):
                return {"snapshot_id": snapshot_id, "paper_count": old["paper_count"], "coverage": json.loads(old["coverage"]), "known_gaps": old["known_gaps"], "status": "already_published"}
            raise ValueError(f"Snapshot {snapshot_id} already exists with different contents; snapshots are immutable")
        version = members.select("paper_version_id").distinct()
        records = self.store.read("scientific_records").join(version, "paper_version_id", "left_semi")
        vectors = self.store.read("embeddings").join(version, "paper_version_id", "left_semi")
        count, n_records, n_vectors = members.count(), records.count(), vectors.count()
        classes = [r[0] for r in self.store.read("papers").join(members.select(F.col("paper_id").alias("id")), "id", "left_semi").select("source_class").distinct().orderBy("source_class").collect()]
        coverage = {"from_date": start, "to_date": end, "category": category, "primary_only": primary_only, "source_classes": classes}
        if category:
            coverage |= catalog.coverage(self.store.read("discovery_records"), category=category, primary_only=primary_only, start=start, end=end, order=F.desc("updated_at")).first().asDict()
        gaps = catalog.known_gaps(coverage.get("unavailable_papers", 0), n_vectors, n_records)
        tag = F.lit(snapshot_id).alias("snapshot_id")
        head = self.spark.createDataFrame([(snapshot_id, start, end, datetime.fromisoformat(now) if now else datetime.now(UTC), count, {"schema": "2", "embedding_model": self.model}, json.dumps(coverage, sort_keys=True), gaps, "published")], heads.schema)
        with self.store.transaction(f"snapshot {snapshot_id}") as change:
            change.append("snapshot_papers", members.select(tag, "paper_id", "paper_version_id"))
            change.append("snapshot_records", records.select(tag, F.col("id").alias("record_id")))
            change.append("snapshot_embeddings", vectors.select(tag, "record_id", "model"))
            change.append("snapshots", head)
        return {"snapshot_id": snapshot_id, "paper_count": count, "coverage": coverage, "known_gaps": gaps, "scientific_record_count": n_records, "embedding_count": n_vectors, "status": "published"}

    def snapshot_info(self, snapshot_id: str | None = None) -> dict:
        heads = self.store.read("snapshots")
        row = (heads.filter(F.col("id") == snapshot_id) if snapshot_id else heads.filter("status = 'published'").orderBy(F.desc("created_at"))).limit(1).first()
        if row is None:
            raise KeyError(f"Unknown snapshot: {snapshot_id}" if snapshot_id else "No published snapshot exists")
        out = row.asDict() | {"coverage": json.loads(row["coverage"])}
        for name, counted in (("snapshot_records", "scientific_record_count"), ("snapshot_embeddings", "embedding_count")):
            out[counted] = self.store.read(name).filter(F.col("snapshot_id") == row["id"]).count()
        return out

    # search

    def _visible(self, rows: DataFrame, snapshot_id: str | None) -> DataFrame:
        """Rows (paper_version_id) of a snapshot, or of the current versions."""
        return rows.join(self._visible_versions(snapshot_id), "paper_version_id", "left_semi")

    def _visible_versions(self, snapshot_id: str | None) -> DataFrame:
        if snapshot_id:
            self.snapshot_info(snapshot_id)
            return self.store.read("snapshot_papers").filter(F.col("snapshot_id") == snapshot_id).select("paper_version_id")
        return self.store.read("paper_versions").filter("is_current").select(F.col("id").alias("paper_version_id"))

    def _indexed(self, ids: list[str] | None = None) -> DataFrame:
        """Passages with their papers: all, or those with these identifiers."""
        return self._with_papers(self.store.read("evidence_passages") if ids is None else self.store.lookup("evidence_passages", ids))

    def _with_papers(self, passages: DataFrame) -> DataFrame:
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), "abstract", "source_class", "source_url", "published_date")
        own = passages.select(F.col("id").alias("evidence_id"), "paper_id", "paper_version_id", "text", "page_start", "page_end", F.array_join("section_path", " ").alias("section"))
        return own.join(papers, "paper_id")

    def _lexical(self, query: str, snapshot_id: str | None, synthetic: bool, limit: int) -> DataFrame:
        """(evidence_id, score) of the best passages by the stored index; statistics are those of the whole index, filters come after."""
        seen = self._visible_versions(snapshot_id)
        keep = None if synthetic else F.col("source_class") != "synthetic"
        found = self.passage_index().search(query_phrases(query), PASSAGE_FIELDS, limit=limit, keep=keep, only=seen)
        return found.select(F.col("id").alias("evidence_id"), "score")

    def search(self, query: str, *, snapshot_id: str | None = None, include_synthetic: bool = False, limit: int = 20) -> dict:
        self._check(limit)
        best = {r["evidence_id"]: r["score"] for r in self._lexical(query, snapshot_id, include_synthetic, limit).collect()}
        # a hundred rows at most: their texts come from the parts that hold them
        score = F.element_at(F.create_map(*[F.lit(x) for pair in best.items() for x in pair]), F.col("evidence_id")) if best else F.lit(0.0)
        shown = self._indexed(list(best)).withColumn("score", score) if best else self._indexed().withColumn("score", score).limit(0)
        return self._answer(query, snapshot_id, shown.withColumn("match_reason", F.concat(F.lit("Full-text match in "), F.col("section"))).orderBy(F.desc("score"), "evidence_id"))

    def search_figures(self, query: str, *, snapshot_id: str | None = None, limit: int = 20) -> dict:
        self._check(limit)
        passages = self.store.read("evidence_passages").select(F.col("id").alias("e"), "text")
        figures = self.store.read("visual_evidence")
        near = figures.select("id", F.explode_outer("nearby_evidence_ids").alias("e")).join(passages, "e", "left").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.substring("text", 1, 500))), " ").alias("nearby"))
        titles = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"))
        rows = figures.select("id", "paper_id", "paper_version_id", "page_number", "label", "caption").join(near, "id").join(titles, "paper_id")
        found = self._visible(lexical.scored(rows, {"title": 4, "label": 2, "caption": 3, "nearby": 1}, query_phrases(query), analyzer=self.analyzer), snapshot_id)
        return self._answer(query, snapshot_id, found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(limit))

    def search_catalog(self, query: str, *, category: str | None = None, primary_only: bool = False, start: str | None = None, end: str | None = None, snapshot_id: str | None = None, limit: int = 20) -> dict:
        self._check(limit)
        rows = self.store.read("discovery_records").withColumn("who", F.array_join("authors", " ")).withColumn("what", F.array_join("categories", " "))
        best = catalog.canonical(self.store.read("discovery_records"), "source_id", F.desc("updated_at"), F.desc("id")).select("id")
        found = lexical.scored(rows, {"title": 5, "abstract": 2, "who": 0.5, "what": 0.2}, query_phrases(query), analyzer=self.analyzer).join(best, "id", "left_semi").filter(catalog.date_filter("published_date", start, end))
        if category:
            found = found.filter(catalog.category_filter(category, primary_only))
        if snapshot_id:
            found = found.join(self.store.read("snapshot_papers").filter(F.col("snapshot_id") == snapshot_id).select("paper_id"), "paper_id", "left_semi")
        shown = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc("published_date"), "id").limit(limit)
        return self._answer(query, snapshot_id, shown.select("id", "source_id", "title", "abstract", "authors", "categories", "primary_category", "published_date", "status", "paper_id", "score"))

    def search_metadata(self, query: str, *, limit: int = 20) -> list[dict]:
        """Catalog rows that match every word of the query, best first."""
        self._check(limit)
        rows = self.store.read("discovery_records").withColumn("who", F.array_join("authors", " ")).withColumn("what", F.array_join("categories", " "))
        found = lexical.scored(rows, {"title": 4, "abstract": 1, "who": 0.3, "what": 0.2}, query_phrases(query, most=10_000), every=True, analyzer=self.analyzer)
        return [r.asDict() for r in found.withColumn("score", -F.round("score", 6)).orderBy("score", F.desc("published_date"), "id").limit(limit).select("id", "source_id", "title", "published_date", "score").collect()]

    def hybrid_search(self, query: str, *, snapshot_id: str | None = None, include_synthetic: bool = False, limit: int = 20) -> dict:
        words = self._lexical(query, snapshot_id, include_synthetic, 100).select(F.col("evidence_id").alias("id"), "score")
        mine = self.store.read("embeddings").filter(F.col("model") == self.model)
        eligible = self._visible(self._indexed(), snapshot_id)
        eligible = eligible if include_synthetic else eligible.filter("source_class <> 'synthetic'")
        candidates = mine.join(eligible.select(F.col("evidence_id").alias("record_id")), "record_id", "left_semi")
        near = fusion.dense_search(candidates, "vector", self.provider.embed([query])[0], id="record_id", limit=100).select("id", F.col("similarity").alias("score"))
        both = fusion.fused(words, near, limit)
        shown = both.withColumnRenamed("id", "evidence_id").join(self._indexed(), "evidence_id").orderBy(F.desc("score"), "evidence_id")
        out = self._answer(query, snapshot_id, shown.limit(limit))
        share = fusion.coverage(eligible.select(F.col("evidence_id").alias("record_id")), mine, "record_id").first()
        out["coverage"]["semantic_index"] = {"model": self.model, "embedded_passages": share["embedded"], "eligible_passages": share["eligible"], "complete": share["embedded"] == share["eligible"]}
        if not share["embedded"]:
            out["warnings"].append("No stored embeddings were available; run enrich.")
        elif share["embedded"] < share["eligible"]:
            out["warnings"].append(f"Semantic coverage is partial: {share['embedded']} of {share['eligible']} eligible passages have embeddings for this model.")
        return out

    def novelty_check(self, idea: str, *, snapshot_id: str | None = None, nearest_papers: int = 12) -> dict:
        """Prior work near an idea, and the provider's judgement with citations outside the retrieved set dropped."""
        found = self.hybrid_search(idea, snapshot_id=snapshot_id, limit=max(20, 3 * nearest_papers))
        papers: dict[str, list] = {}
        for row in found["results"]:
            if row["paper_id"] in papers and len(papers) >= nearest_papers:
                continue
            papers.setdefault(row["paper_id"], []).append(row["evidence_id"])
            if len(papers) >= nearest_papers and sum(map(len, papers.values())) >= 2 * nearest_papers:
                break
        allowed = {e for ids in papers.values() for e in ids}
        answer = self.provider.structured(f"novelty: {idea}", {})
        cited = [e for e in answer.get("evidence_ids", []) if e in allowed]
        return found | {"nearest": [{"paper_id": p, "evidence_ids": ids} for p, ids in list(papers.items())[:nearest_papers]], "assessment": answer | {"evidence_ids": cited}}

    def discover_opportunities(self, topic: str, *, snapshot_id: str | None = None, limit: int = 3) -> dict:
        found = self.hybrid_search(topic, snapshot_id=snapshot_id, limit=30)
        allowed = {r["evidence_id"] for r in found["results"]}
        kept = []
        for item in self.provider.structured(f"opportunities: {topic}", {}).get("candidates", []):
            cited = [e for e in item.get("evidence_ids", []) if e in allowed]
            if cited and item.get("hypothesis") and item.get("experiment"):
                kept.append(item | {"evidence_ids": cited})
        return found | {"opportunities": kept[:limit]}

    # look-ups

    def get_evidence(self, ids: list[str]) -> dict:
        if not ids:
            raise ValueError("one evidence id or more is needed")
        rows = self._indexed(ids)
        out = self._answer(",".join(ids), None, rows)
        missing = sorted(set(ids) - {r["evidence_id"] for r in out["results"]})
        if missing:
            out["warnings"].append(f"Unknown evidence ids: {', '.join(missing)}")
        return out

    def get_paper(self, paper_id: str, *, snapshot_id: str | None = None) -> dict:
        paper = self.store.read("papers").filter(F.col("id") == paper_id).first()
        if paper is None:
            raise KeyError(f"Unknown paper: {paper_id}")
        version = self._visible(self.store.read("paper_versions").withColumn("paper_version_id", F.col("id")), snapshot_id).filter(F.col("paper_id") == paper_id).first()
        if version is None:
            raise KeyError(f"Paper {paper_id} is not in this view")
        sections = self.store.read("sections").filter(F.col("paper_version_id") == version["id"]).orderBy("ordinal").collect()
        figures = self.store.read("visual_evidence").filter(F.col("paper_version_id") == version["id"]).orderBy("page_number", "label").collect()
        liked = not self.store.read("paper_favorites").filter(F.col("paper_id") == paper_id).isEmpty()
        return paper.asDict() | {"paper_version_id": version["id"], "is_favorite": liked, "sections": [r.asDict() for r in sections], "figures": [r.asDict() for r in figures]}

    def related_papers(self, paper_id: str, *, snapshot_id: str | None = None, limit: int = 20) -> dict:
        self._check(limit)
        row = self.store.read("papers").filter(F.col("id") == paper_id).select(t.related_terms(F.concat_ws(" ", "canonical_title", "abstract")).alias("w")).first()
        if row is None:
            raise KeyError(f"Unknown paper: {paper_id}")
        out = self.search_catalog(" ".join(row["w"]), snapshot_id=snapshot_id, limit=min(100, limit + 5))
        out["results"] = [r for r in out["results"] if r["paper_id"] != paper_id][:limit]
        return out

    def get_figure(self, figure_id: str) -> dict:
        row = self.store.read("visual_evidence").filter(F.col("id") == figure_id).first()
        if row is None:
            raise KeyError(f"Unknown figure: {figure_id}")
        return row.asDict()

    def get_scientific_records(self, *, paper_id: str | None = None, snapshot_id: str | None = None, record_types: list[str] | None = None, limit: int = 100) -> list[dict]:
        if not 1 <= limit <= 500:
            raise ValueError("limit must be between 1 and 500")
        rows = self._visible(self.store.read("scientific_records"), snapshot_id)
        if paper_id:
            rows = rows.filter(F.col("paper_id") == paper_id)
        if record_types:
            rows = rows.filter(F.col("record_type").isin(record_types))
        cited = self.store.read("record_evidence").groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
        return [r.asDict() for r in rows.join(cited, "id", "left").orderBy(F.desc("created_at"), "id").limit(limit).collect()]

    def corpus_status(self) -> dict:
        one = self.store.read("discovery_records").agg(F.countDistinct("source_id").alias("catalog_papers"))
        for name, source in (("full_text_papers", "papers"), ("evidence_passages", "evidence_passages"), ("embeddings", "embeddings"), ("scientific_records", "scientific_records"), ("visual_evidence", "visual_evidence")):
            one = one.crossJoin(self.store.read(source).agg(F.count(F.lit(1)).alias(name)))
        out = one.first().asDict()
        out["models"] = {r["model"]: r["count"] for r in self.store.read("embeddings").groupBy("model").count().collect()}
        out["record_types"] = {r["record_type"]: r["count"] for r in self.store.read("scientific_records").groupBy("record_type").count().collect()}
        return out

    def set_favorite(self, paper_id: str, favorite: bool) -> None:
        if self.store.read("papers").filter(F.col("id") == paper_id).isEmpty():
            raise KeyError(f"Unknown paper: {paper_id}")
        one = self.spark.range(1).select(F.lit(paper_id).alias("paper_id"), F.current_timestamp().alias("created_at"))
        if favorite:
            self.store.upsert("paper_favorites", one, how="first")
        else:
            self.store.delete("paper_favorites", one.select("paper_id"))

    def paper_features(self, snapshot_id: str) -> DataFrame:
        """(paper_id, title, abstract, tokens, vector) of a snapshot's papers: abstracts with the papers' statements, mean passage vectors folded."""
        pinned = self.store.read("snapshot_papers").filter(F.col("snapshot_id") == snapshot_id).select("paper_id", "paper_version_id")
        papers = self.store.read("papers").withColumnRenamed("id", "paper_id").join(pinned, "paper_id")
        statements = self.store.read("scientific_records").groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_list("statement")), " ").alias("said"))
        own = papers.join(statements, "paper_id", "left").select("paper_id", F.col("canonical_title").alias("title"), F.concat_ws(" ", "abstract", "said").alias("abstract"))
        vectors = self.store.read("embeddings").filter(F.col("model") == self.model).join(pinned, "paper_version_id").withColumn("f", folded(F.col("vector")))
        means = fusion.centroids(vectors, "paper_id", "f").groupBy(F.col("group").alias("paper_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector"))
        return cluster.features(own, means).join(own.select("paper_id", "abstract"), "paper_id")

    def research_groups(self, *, today: str) -> dict:
        """The stored groups, or ``not_ready``."""
        from fathomline.plans.organisation import Organisation

        return Organisation(self).latest(today=today)

    def favorites(self) -> list[dict]:
        """Favourite papers, the latest first."""
        papers = self.store.read("papers").select(F.col("id").alias("paper_id"), F.col("canonical_title").alias("title"), "published_date", "source_url")
        return [r.asDict() for r in self.store.read("paper_favorites").join(papers, "paper_id").orderBy(F.desc("created_at"), "title").collect()]

    # envelope

    @staticmethod
    def _check(limit: int) -> None:
        if not 1 <= limit <= 100:
            raise ValueError("limit must be between 1 and 100")

    def _answer(self, query: str, snapshot_id: str | None, rows: DataFrame) -> dict:
        results = [r.asDict(recursive=True) for r in rows.collect()]
        warnings, at = [], datetime.now(UTC).isoformat()
        if snapshot_id:
            head = self.snapshot_info(snapshot_id)
            coverage = head["coverage"] | {"paper_count": head["paper_count"]}
            warnings += head["known_gaps"]
        else:
            warnings.append("No snapshot selected; results use the current mutable working set.")
            coverage = {"paper_count": self.store.read("papers").count()}
        if not results:
            warnings.append("No matching evidence was found; no fallback results were invented.")
        return {"results": results, "coverage": coverage, "warnings": warnings, "provenance": {"snapshot_id": snapshot_id, "query": query, "retriever_version": "bm25", "generated_at": at}}

    def tool(self, name: str, arguments: dict):
        """The read-only tool surface by name."""
        tools = {"search_catalog": self.search_catalog, "search_papers": self.search, "search_figures": self.search_figures, "hybrid_search": self.hybrid_search, "check_idea_novelty": self.novelty_check, "discover_opportunities": self.discover_opportunities, "get_paper": self.get_paper, "find_related_papers": self.related_papers, "get_scientific_records": self.get_scientific_records, "get_figure": self.get_figure, "get_evidence": lambda evidence_ids: self.get_evidence(evidence_ids), "get_snapshot_info": self.snapshot_info, "get_corpus_status": self.corpus_status, "get_research_groups": self.research_groups}
        if name not in tools:
            raise KeyError(f"Unknown tool: {name}")
        return tools[name](**arguments)
