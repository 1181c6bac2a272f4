"""Catalog ingestion as resumable batches: discovery by pages, month segments, acquisition with a status for each record, roll-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import scholarly_id
from fathomline.operators import catalog, citations
from fathomline.plans.engine import Engine

# Fixed value: results beyond which a source wants monthly segments.
MOST_RESULTS = 30_000
CITATIONS = "semantic_scholar"


@dataclass(frozen=True)
class Harvest:
    category: str
    start: str
    end: str
    page_size: int = 250
    delay: float = 3.1
    limit: int | None = None

    def validate(self) -> None:
        if "." not in self.category:
            raise ValueError("category must have an archive and a subject, as in cs.AI")
        if date.fromisoformat(self.start) > date.fromisoformat(self.end):
            raise ValueError("the first date must not come after the last")
        if not 1 <= self.page_size <= 1000:
            raise ValueError("page size must be between 1 and 1000")
        if self.delay < 3.0:
            raise ValueError("requests must be 3 seconds apart at least")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be 1 or more")


def _key(prefix: str, value: dict) -> str:
    import hashlib

    return f"{prefix}_{hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:20]}"


class Ingestion:
    """client.page(config, cursor) -> (rows, total): catalog rows as dicts with source_id, title, abstract, authors, categories, primary_category,
    published_date, updated_at, abstract_url, pdf_url."""

    def __init__(self, engine: Engine, client) -> None:
        self.engine, self.client, self.spark = engine, client, engine.spark

    @property
    def store(self):
        return self.engine.store

    def _set(self, table: str, **row) -> None:
        self.store.set(table, row.pop("id"), **row)

    def discover(self, config: Harvest) -> dict:
        """Take in the pages from where the run stopped; a run that is through returns at once."""
        config.validate()
        run = _key("run", asdict(config))
        known = self.store.read("ingestion_runs").filter(F.col("id") == run).first()
        if known and known["status"] in ("discovered", "complete"):
            return self.status(run)
        cursor = (known["next_cursor"] or 0) if known else 0
        self._set("ingestion_runs", id=run, source="arxiv", category=config.category, from_date=config.start, to_date=config.end, status="discovering", next_cursor=cursor)
        total = None
        while config.limit is None or cursor < config.limit:
            size = config.page_size if config.limit is None else min(config.page_size, config.limit - cursor)
            rows, total = self.client.page(config, cursor, size)
            if rows:
                self._add(run, rows)
            cursor += len(rows)
            self._set("ingestion_runs", id=run, next_cursor=cursor, total_results=total)
            if total > MOST_RESULTS and config.limit is None:
                self._set("ingestion_runs", id=run, status="partition_required")
                return self.status(run)
            if len(rows) < size:
                break
        self._set("ingestion_runs", id=run, status="discovered", discovered_count=self._records(run).count(), total_results=total)
        return self.status(run)

    def _add(self, run: str, rows: list[dict]) -> None:
        stored = self.store.read("discovery_records")
        fill = {"run_id": run, "source": "arxiv", "status": "discovered", "attempts": 0}
        values = [tuple((r | fill | {"id": _key("disc", {"run": run, "source_id": r["source_id"]})}).get(c) for c in stored.columns) for r in rows]
        page = self.spark.createDataFrame(values, stored.schema).withColumn("discovered_at", F.current_timestamp())
        self.engine.add_discoveries(page)

    def _records(self, run: str) -> DataFrame:
        return self.store.read("discovery_records").filter(F.col("run_id") == run)

    def discover_monthly(self, config: Harvest) -> dict:
        """One run for each calendar month of the range, tied to a group; a limit of the range doesn't hold for the months."""
        config.validate()
        group = _key("group", asdict(config) | {"partition": "month"})
        groups = self.store.read("ingestion_groups")
        if groups.filter(F.col("id") == group).isEmpty():
            self._set("ingestion_groups", id=group, source="arxiv", category=config.category, query=json.dumps(asdict(config)), status="discovering")
        links = self.store.read("ingestion_group_runs")
        for k, piece in enumerate(catalog.month_segments(self.spark, config.start, config.end).orderBy("segment_start").collect()):
            found = self.discover(Harvest(config.category, str(piece["segment_start"]), str(piece["segment_end"]), config.page_size, config.delay))
            link = self.spark.createDataFrame([(group, found["id"], k)], links.schema)
            self.store.upsert("ingestion_group_runs", link, how="first")
        self._set("ingestion_groups", id=group, status="discovered")
        return self.group_status(group)

    def acquire(self, run: str, fetch, *, limit: int | None = None, retry_failed: bool = False, primary_only: bool = False, ids: list[str] | None = None) -> dict:
        """Fetch the texts of a run's records; fetch(row) returns a text or raises, where the record lies. Failures are kept with the record.

        Order: date, then source identifier."""
        head = self.store.read("ingestion_runs").filter(F.col("id") == run).first()
        if head is None:
            raise KeyError(f"Unknown ingestion run: {run}")
        wanted = self._records(run).filter(F.col("status").isin(["discovered", "failed"] if retry_failed else ["discovered"]))
        if primary_only:
            wanted = wanted.filter(F.col("primary_category") == head["category"])
        if ids is not None:
            wanted = wanted.filter(F.col("id").isin(ids))
        wanted = wanted.orderBy("published_date", "source_id")
        if limit is not None:
            wanted = wanted.limit(limit)
        self._set("ingestion_runs", id=run, status="acquiring")

        def run_fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    try:
                        out.append((row["id"], fetch(row), None, None))
                    except Exception as error:  # noqa: BLE001  a record's failure is its result
                        out.append((row["id"], None, type(error).__name__, str(error)[:1000]))
                yield pd.DataFrame(out, columns=["id", "text", "code", "message"])

        got = wanted.select("id", "source_id", "title", "pdf_url", "abstract_url").mapInPandas(run_fetch, "id string, text string, code string, message string").persist()
        full = got.filter("text is not null").join(self._records(run), "id")
        if not full.isEmpty():
            self.engine.ingest(full.select("title", "text", "authors", "abstract", "published_date", F.col("abstract_url").alias("source_url"), F.lit("preprint").alias("source_class")))
        from fathomline.functions.text import normal_title, stable_id

        stored = self.store.read("discovery_records")
        done = stored.join(got.select("id", F.col("code").alias("__c"), F.col("message").alias("__m"), F.col("text").isNotNull().alias("__ok")), "id")
        updated = done.withColumn("status", F.when(F.col("__ok"), "acquired").otherwise("failed")).withColumn("paper_id", F.when(F.col("__ok"), stable_id("paper", normal_title(F.col("title")))).otherwise(F.col("paper_id"))).withColumn("attempts", F.col("attempts") + 1).withColumn("error_code", F.col("__c")).withColumn("error_message", F.col("__m"))
        self.store.upsert("discovery_records", updated.select(stored.columns))
        got.unpersist()
        counts = self.status(run)["records_by_status"]
        self._set("ingestion_runs", id=run, status="discovered" if counts.get("discovered") else "complete", acquired_count=counts.get("acquired", 0), failed_count=counts.get("failed", 0))
        return self.status(run)

    def acquire_group(self, group: str, fetch, *, limit: int | None = None, **options) -> dict:
        """The group's runs in order, sharing one limit."""
        self._set("ingestion_groups", id=group, status="acquiring")
        left = limit
        for row in self.store.read("ingestion_group_runs").filter(F.col("group_id") == group).orderBy("ordinal").collect():
            if left is not None and left <= 0:
                break
            before = self._tried(row["run_id"])
            self.acquire(row["run_id"], fetch, limit=left, **options)
            if left is not None:
                left -= self._tried(row["run_id"]) - before
        pending = self.group_status(group)["discovered_only"]
        self._set("ingestion_groups", id=group, status="complete" if not pending else "budgeted" if limit is not None else "discovered")
        return self.group_status(group)

    def _tried(self, run: str) -> int:
        return self._records(run).agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0]

    def status(self, run: str) -> dict:
        head = self.store.read("ingestion_runs").filter(F.col("id") == run).first()
        if head is None:
            raise KeyError(f"Unknown ingestion run: {run}")
        return head.asDict() | {"records_by_status": {r["status"]: r["count"] for r in self._records(run).groupBy("status").count().collect()}}

    def group_status(self, group: str) -> dict:
        head = self.store.read("ingestion_groups").filter(F.col("id") == group).first()
        if head is None:
            raise KeyError(f"Unknown ingestion group: {group}")
        links = self.store.read("ingestion_group_runs").filter(F.col("group_id") == group)
        rows = self.store.read("discovery_records").join(links, "run_id").withColumn("group_id", F.lit(group))
        counts = catalog.status_counts(rows, "group_id", F.col("primary_category") == head["category"]).first()
        out = head.asDict() | {"runs": links.count()} | (counts.asDict() if counts else {"discovered": 0, "acquired": 0, "failed": 0, "primary_total": 0, "primary_pending": 0})
        return out | {"discovered_only": rows.filter("status = 'discovered'").count()}

    def refresh_citations(self, provider, now: str, *, stale_days: int = 7, batch: int = 500, writers: int = 1) -> dict:
        """Citation counts of papers that have none or old ones; answers that don't match are skipped, a failed batch doesn't stop the rest."""
        if stale_days < 0:
            raise ValueError("stale_days cannot be negative")
        at = F.lit(now).cast("timestamp")
        fresh = self.store.read("paper_citation_metrics").filter((F.col("provider") == CITATIONS) & (F.datediff(at, "fetched_at") < stale_days)).select(F.col("paper_id").alias("id"))
        rows = self.store.read("papers").join(fresh, "id", "left_anti").select("id", scholarly_id(F.col("source_url")).alias("key")).filter("key is not null")
        return self._counts("paper_citation_metrics", "paper_id", rows, provider, at, batch, writers)

    def refresh_discovery_citations(self, group: str, provider, now: str, *, batch: int = 500, writers: int = 1) -> dict:
        """Citation counts of a group's open discoveries that have none yet: signals for the priorities, before anything is fetched."""
        links = self.store.read("ingestion_group_runs").filter(F.col("group_id") == group).select("run_id")
        known = self.store.read("discovery_citation_metrics").filter(F.col("provider") == CITATIONS).select(F.col("discovery_id").alias("id"))
        open_rows = self.store.read("discovery_records").join(links, "run_id", "left_semi").filter(F.col("status").isin("discovered", "failed")).join(known, "id", "left_anti")
        rows = open_rows.select("id", F.concat(F.lit("ARXIV:"), F.regexp_replace("source_id", "v[0-9]+$", "")).alias("key"))
        return self._counts("discovery_citation_metrics", "discovery_id", rows, provider, F.lit(now).cast("timestamp"), batch, writers)

    def _counts(self, table: str, key: str, rows: DataFrame, provider, at, batch: int, writers: int) -> dict:
        with self.store.scratch() as path:
            citations.asked(rows, provider, batch=batch, writers=writers).write.parquet(path)  # the service is asked once
            answers = self.spark.read.parquet(path)
            told = citations.tally(answers).first().asDict()
            if told["refreshed"]:
                new = answers.filter("state = 'ok'").withColumnsRenamed({"id": key, "work_id": "provider_work_id"})
                self.store.upsert(table, new.withColumn("provider", F.lit(CITATIONS)).withColumn("match_method", F.lit("id")).withColumn("match_confidence", F.lit(1.0)).withColumn("fetched_at", at))
            warnings = [r["message"] for r in answers.filter("message is not null").select("message").distinct().orderBy("message").limit(20).collect()]
        return told | {"updated": told["refreshed"], "failed_batches": -(-told["failed"] // batch), "warnings": warnings}


def look_back(today: str, days: int = 3) -> tuple[str, str]:
    """The overlapping window of a daily run: ``days`` days that end yesterday."""
    from datetime import timedelta

    end = date.fromisoformat(today) - timedelta(days=1)
    return str(end - timedelta(days=days - 1)), str(end)
