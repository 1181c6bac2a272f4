"""Schemas of the engine's tables with their keys, and the store: Parquet folders that a log of commits makes visible.

A change writes the rows that it changes, dealt to parts by the hash of their key, and then one commit; what is stored already stays where it is. A reader takes of each key the row of the
latest commit; deleted keys leave a mark. When a table has many such deltas, the parts that they touch, and no others, are merged and written anew (``compact``).
Several tables can change in one commit (``transaction``). Two writers never get one number; a writer whose rows were worked out from parts that another changed meanwhile
works them out again."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.sources.log import CommitLog, Conflict, State

SCHEMAS = {
    "papers": "id string, canonical_title string, normalized_title string, abstract string, authors array<string>, published_date string, source_url string, source_class string, created_at timestamp",
    "paper_versions": "id string, paper_id string, content_hash string, artifact_uri string, acquired_at timestamp, is_current boolean",
    "sections": "id string, paper_version_id string, heading string, ordinal int, page_start int, page_end int, text string",
    "evidence_passages": "id string, paper_id string, paper_version_id string, section_id string, page_start int, page_end int, section_path array<string>, text string, content_hash string, extraction_confidence double, created_at timestamp",
    "visual_evidence": "id string, paper_id string, paper_version_id string, page_number int, label string, caption string, artifact_uri string, content_hash string, artifact_kind string, nearby_evidence_ids array<string>, extraction_method string, created_at timestamp",
    "snapshots": "id string, from_date string, to_date string, created_at timestamp, paper_count int, versions map<string,string>, coverage string, known_gaps array<string>, status string",
    "snapshot_papers": "snapshot_id string, paper_id string, paper_version_id string",
    "embeddings": "record_id string, paper_version_id string, model string, dimensions int, vector array<double>, created_at timestamp",
    "scientific_records": "id string, paper_id string, paper_version_id string, record_type string, title string, statement string, conditions array<string>, numeric_values array<string>, confidence double, extractor_version string, created_at timestamp",
    "record_evidence": "record_id string, evidence_id string, relation string",
    "scientific_extractions": "paper_version_id string, record_type string, extractor_version string, status string, record_count int, rejected_count int, completed_at timestamp",
    "daily_digest_runs": "id string, run_date string, snapshot_id string, client string, status string, candidate_ids array<string>, headline string, synthesis string, trends array<string>, model string, error string, created_at timestamp, completed_at timestamp",
    "daily_blogs": "id string, run_id string, paper_id string, slug string, title string, dek string, surprise string, body string, evidence_ids array<string>, figure_ids array<string>, themes array<string>, related_paper_ids array<string>, source_url string, published_date string, created_at timestamp",
    "daily_blog_personalization": "blog_id string, mode string, reason string, matched_labels array<string>, matched_favorites array<string>",
    "paper_favorites": "paper_id string, created_at timestamp",
    "preference_sources": "source string, enabled boolean, consented_at timestamp, updated_at timestamp",
    "preference_sessions": "fingerprint string, source string, content_digest string, observed_at timestamp, turn_count int, status string, processed_at timestamp",
    "preference_events": "id string, source string, session_fingerprint string, kind string, label string, context string, confidence double, explicitness string, observed_at timestamp, created_at timestamp",
    "preference_profile_versions": "id string, summary string, active_for_ingestion boolean, created_at timestamp",
    "explicit_interest_profile": "singleton int, text string, extraction_status string, updated_at timestamp",
    "paper_citation_metrics": "paper_id string, provider string, provider_work_id string, citation_count int, influential_citation_count int, reference_count int, match_method string, match_confidence double, fetched_at timestamp",
    "discovery_citation_metrics": "discovery_id string, provider string, citation_count int, influential_citation_count int, fetched_at timestamp",
    "paper_priority_scores": "discovery_id string, profile_version_id string, affinity_score double, frontier_score double, exploration_score double, final_score double, lane string, explanation string, created_at timestamp",
    "organization_runs": "id string, run_date string, snapshot_id string, algorithm string, embedding_model string, status string, configuration string, summary string, created_at timestamp",
    "paper_clusters": "id string, run_id string, ordinal int, label string, description string, top_terms array<string>, paper_count int, new_count int, average_similarity double",
    "paper_cluster_members": "cluster_id string, paper_id string, similarity double, is_new boolean",
    "research_artifacts": "id string, kind string, snapshot_id string, query string, payload string, evidence_ids array<string>, created_at timestamp",
    "snapshot_records": "snapshot_id string, record_id string",
    "snapshot_embeddings": "snapshot_id string, record_id string, model string",
    "ingestion_runs": "id string, source string, category string, from_date string, to_date string, status string, next_cursor int, total_results int, discovered_count int, acquired_count int, failed_count int, created_at timestamp, updated_at timestamp",
    "discovery_records": "id string, run_id string, source string, source_id string, title string, abstract string, authors array<string>, categories array<string>, primary_category string, published_date string, updated_at string, abstract_url string, pdf_url string, status string, paper_id string, attempts int, error_code string, error_message string, discovered_at timestamp",
    "ingestion_groups": "id string, source string, category string, query string, status string, created_at timestamp, updated_at timestamp",
    "ingestion_group_runs": "group_id string, run_id string, ordinal int",
}

#: Tables of the engine's own, beside the 33.
OWN_SCHEMAS = {
    "discovery_vectors": "discovery_id string, model string, vector array<double>, created_at timestamp",
    "discovery_relevance": "discovery_id string, profile_version_id string, model string, relevance double, reason string, created_at timestamp",
    "workflow_steps": "workflow string, step string, inputs string, result string, finished_at timestamp",
}

KEYS = {
    "discovery_vectors": ["discovery_id", "model"],
    "discovery_relevance": ["discovery_id", "profile_version_id", "model"],
    "workflow_steps": ["workflow", "step"],
    "snapshot_papers": ["snapshot_id", "paper_id"],
    "embeddings": ["record_id", "model"],
    "record_evidence": ["record_id", "evidence_id"],
    "scientific_extractions": ["paper_version_id", "record_type", "extractor_version"],
    "daily_blog_personalization": ["blog_id"],
    "paper_favorites": ["paper_id"],
    "preference_sources": ["source"],
    "preference_sessions": ["fingerprint"],
    "explicit_interest_profile": ["singleton"],
    "paper_citation_metrics": ["paper_id", "provider"],
    "discovery_citation_metrics": ["discovery_id", "provider"],
    "paper_priority_scores": ["discovery_id", "profile_version_id"],
    "paper_cluster_members": ["cluster_id", "paper_id"],
    "snapshot_records": ["snapshot_id", "record_id"],
    "snapshot_embeddings": ["snapshot_id", "record_id", "model"],
    "ingestion_group_runs": ["group_id", "run_id"],
}


def schema_of(table: str) -> str:
    return SCHEMAS[table] if table in SCHEMAS else OWN_SCHEMAS[table]


def keys(table: str) -> list[str]:
    return KEYS.get(table, ["id"])


class Transaction:
    """Changes of one table or more that become visible together. Reads show what was stored when it began.

    Keys are never null. A change that gives the rows that are stored already writes nothing."""

    def __init__(self, store: Store, name: str | None = None) -> None:
        self.store, self.name = store, name
        self.base = store.log.state()
        self.add: dict[str, dict] = {}
        self.remove: list[str] = []
        self.shrink: dict[str, list[int]] = {}
        self.reads: dict[str, set[int] | None] = {}  # table -> parts that the change was worked out from, None for all

    def read(self, table: str) -> DataFrame:
        return self.store._read(self.base, table)

    def _parts(self, rows: DataFrame, table: str) -> set[int]:
        """The parts that the rows' keys fall into: at most as many numbers as the store has parts."""
        return {r[0] for r in rows.select(self.store._part(table).alias("part")).distinct().collect()}

    def _seen(self, table: str, parts: set[int] | None) -> None:
        known = self.reads.get(table, set())
        self.reads[table] = None if parts is None or known is None else known | parts

    def _put(self, table: str, rows: DataFrame, kind: str = "delta", few: bool = False) -> list[int]:
        """Write rows (with ``_gone``) below a folder of their own; the parts that got any."""
        folder = f"{table}/{kind}-{uuid.uuid4().hex}"
        path = f"{self.store.root}/{folder}"
        out = rows.withColumn("_part", self.store._part(table))
        # as many files as the rows call for, however they are spread over the parts
        (out.coalesce(1) if few else out.hint("rebalance", "_part")).write.partitionBy("_part").parquet(path)
        parts = sorted(int(n.removeprefix("_part=")) for n in self.store.log.files.names(path) if n.startswith("_part="))
        if parts:
            self.add[folder] = {"table": table, "kind": kind, "parts": parts}
        else:
            self.store.log.files.delete(path)
        return parts

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows with keys of their own; nothing stored is read. A key that is stored has its row replaced."""
        self._put(table, self.store._shaped(table, rows).dropDuplicates(keys(table)).withColumn("_gone", F.lit(False)))

    def lookup(self, table: str, ids: list[str]) -> DataFrame:
        return self.store.lookup(table, ids, self.base)

    def set(self, table: str, id: str, **fields) -> None:
        """One row, by its identifier: these fields change, or it comes in with them. A row that is so already is left alone."""
        found = self.lookup(table, [id]).limit(1).first()
        old = found.asDict() if found else None
        wanted = _struct(schema_of(table))
        new = (old or dict.fromkeys(wanted.names)) | {keys(table)[0]: id} | fields
        if new == old:
            return
        row = self.store.spark.createDataFrame([tuple(new[c] for c in wanted.names)], wanted)
        self._seen(table, set(self._put(table, row.withColumn("_gone", F.lit(False)), few=True)))

    def upsert(self, table: str, rows: DataFrame, *, how: str = "last", fill: list[str] | None = None, order: Column | None = None) -> None:
        """Incoming rows against the stored ones of their keys.

        how: ``last``, the incoming row wins (of several with one key the first by ``order`` descending); ``first``, stored rows stay; ``fill``, stored rows stay but for the
        columns of ``fill``, where an incoming value that isn't empty takes the place of the stored one."""
        key = keys(table)
        incoming = self.store._shaped(table, rows)
        if order is not None:
            ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).filter("__n = 1")
            incoming = self.store._shaped(table, ranked)
        incoming = incoming.dropDuplicates(key).persist()
        try:
            parts = self._parts(incoming, table)
            self._seen(table, parts)
            stored = self.store._read(self.base, table, parts)
            old = stored.join(incoming.select(*key), key, "left_semi").select(F.struct(*stored.columns).alias("old"), *key)
            both = incoming.select(F.struct(*incoming.columns).alias("new"), *key).join(old, key, "left")
            columns = []
            for c in incoming.columns:
                new, had = F.col(f"new.{c}"), F.col(f"old.{c}")
                if how == "first" or (how == "fill" and c not in (fill or [])):
                    value = F.when(F.col("old").isNull(), new).otherwise(had)
                elif how == "fill":
                    value = F.when(F.col("old").isNull() | (new.isNotNull() & (new.cast("string") != "") & (new.cast("string") != "[]")), new).otherwise(had)
                elif how == "last":
                    value = new
                else:
                    raise ValueError(f"unknown rule: {how}")
                columns.append(value.alias(c))
            same = F.lit(True)
            for c in incoming.columns:
                same = same & (F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")) if not _is_map(incoming, c) else F.to_json(f"_o.{c}").eqNullSafe(F.to_json(f"_n.{c}")))
            out = both.select(F.struct(*columns).alias("_n"), F.col("old").alias("_o")).filter(F.col("_o").isNull() | ~same).select("_n.*")
            self._put(table, out.withColumn("_gone", F.lit(False)))
        finally:
            incoming.unpersist()

    def delete(self, table: str, gone: DataFrame) -> None:
        """Stored rows that agree with a row of ``gone`` in all of its columns."""
        self._seen(table, None)
        on = gone.columns
        hit = self.read(table).join(gone.distinct(), on, "left_semi").select(*keys(table))
        self._put(table, self.store._shaped(table, hit).withColumn("_gone", F.lit(True)))

    def replace(self, table: str, rows: DataFrame, groups: DataFrame) -> None:
        """The stored rows of ``groups`` go, ``rows`` come in."""
        key = keys(table)
        self._seen(table, None)
        incoming = self.store._shaped(table, rows).dropDuplicates(key)
        hit = self.read(table).join(groups.distinct(), groups.columns, "left_semi").select(*key).join(incoming.select(*key), key, "left_anti")
        self._put(table, incoming.withColumn("_gone", F.lit(False)).unionByName(self.store._shaped(table, hit).withColumn("_gone", F.lit(True))))

    def write(self, table: str, rows: DataFrame) -> None:
        """The table is these rows from now on, repeated keys included."""
        self._seen(table, None)
        self.remove += [f for f, x in self.base.live.items() if x["table"] == table]
        self._put(table, self.store._shaped(table, rows).withColumn("_gone", F.lit(False)), kind="base")

    def compact(self, table: str) -> None:
        """Merge the parts of a table that have more than one row set."""
        held: dict[int, int] = {}
        own = {f: x for f, x in self.base.live.items() if x["table"] == table}
        for x in own.values():
            for p in x["parts"]:
                held[p] = held.get(p, 0) + 1
        parts = {p for p, n in held.items() if n > 1}
        if not parts:
            return
        self._seen(table, parts)
        self._put(table, self.store._read(self.base, table, parts).withColumn("_gone", F.lit(False)), kind="base")
        for folder, x in own.items():
            if hit := [p for p in x["parts"] if p in parts]:
                self.shrink[folder] = hit

    def _spoilt_by(self, other: dict) -> bool:
        changed: dict[str, set[int]] = {}
        for x in other.get("add", {}).values():
            changed.setdefault(x["table"], set()).update(x["parts"])
        for folder in [*other.get("remove", []), *other.get("shrink", {})]:
            table, parts = folder.split("/")[0], other.get("shrink", {}).get(folder)
            changed.setdefault(table, set()).update(parts if parts is not None else range(self.store.parts))
        return any(table in changed and (parts is None or parts & changed[table]) for table, parts in self.reads.items())

    def commit(self) -> State:
        if not (self.add or self.remove or self.shrink):
            return self.base
        entry = {"add": self.add, "remove": self.remove, "shrink": self.shrink, "settings": {"parts": self.store.parts}} | ({"name": self.name} if self.name else {})
        return self.store.log.commit(entry, self.base, self._spoilt_by)

    def abandon(self) -> None:
        for folder in self.add:
            self.store.log.files.delete(f"{self.store.root}/{folder}")


def _is_map(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() == "map"


class Store:
    """The engine's tables below one folder.

    ``parts`` is the number of key partitions of a new store (a stored one keeps its own): as many as make a part a few gigabytes at most. ``most_deltas`` row sets of a table are read side by side before
    their parts are merged."""

    ATTEMPTS = 8

    def __init__(self, spark: SparkSession, root: str, *, parts: int = 4, most_deltas: int = 8) -> None:
        self.spark, self.root, self.most_deltas = spark, root.rstrip("/"), most_deltas
        self.log = CommitLog(spark, self.root)
        self.parts = self.log.state().settings.get("parts", parts)

    def _part(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys(table)]), F.lit(self.parts)).cast("int")

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """The table's columns; those that the rows lack are null."""
        return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) if f.name in rows.columns else _null(f) for f in _struct(schema_of(table))])

    def _read(self, state: State, table: str, parts: set[int] | None = None) -> DataFrame:
        own = []
        for folder, x in state.live.items():
            if x["table"] == table and (wanted := [p for p in x["parts"] if parts is None or p in parts]):
                own.append((x["v"], x["kind"], [f"{self.root}/{folder}/_part={p}" for p in wanted]))
        schema = schema_of(table) + ", _gone boolean"
        scan = lambda paths: self.spark.read.schema(schema).parquet(*paths)
        key = keys(table)
        base = [paths for _, kind, paths in own if kind == "base"]
        deltas = [(v, paths) for v, kind, paths in own if kind == "delta"]
        # parts of several base folders are disjoint, and older than all deltas
        rows = scan([p for paths in base for p in paths]).drop("_gone") if base else None
        if not deltas:
            return rows if base else self.spark.createDataFrame([], _struct(schema_of(table)))
        latest = None
        for v, paths in deltas:
            one = scan(paths).withColumn("_v", F.lit(v))
            latest = one if latest is None else latest.unionByName(one)
        if len(deltas) > 1:
            latest = latest.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_v")))).filter("_n = 1").drop("_n")
        live = latest.filter("not _gone").drop("_gone", "_v")
        return rows.join(latest.select(*key), key, "left_anti").select(*live.columns).unionByName(live) if base else live

    @property
    def version(self) -> int:
        return self.log.state().version

    def read(self, table: str, *, version: int | None = None) -> DataFrame:
        """The table as the latest commit left it, or an earlier one; columns that stored rows lack (they are older than the schema) come as null."""
        return self._read(self.log.state(version), table)

    def lookup(self, table: str, ids: list[str], state: State | None = None) -> DataFrame:
        """The rows with these identifiers, from the parts that can hold them."""
        key = keys(table)
        if len(key) != 1:
            raise ValueError(f"{table} has no single key")
        # worked out by the planner, without a job
        parts = set(self.spark.sql(f"SELECT transform(:ids, i -> pmod(xxhash64(i), {self.parts}))", args={"ids": F.array(*map(F.lit, ids))}).first()[0])
        return self._read(state or self.log.state(), table, parts).filter(F.col(key[0]).isin(ids))

    def changes(self, table: str, since: int) -> tuple[DataFrame | None, int]:
        """(rows that commits after ``since`` wrote to a table, the latest commit); merging parts changes no row. None where nothing was written, or all of it has been cleared away."""
        now = self.log.state()
        paths = []
        for v in range(since + 1, now.version + 1):
            for folder, x in self.log.entry(v).get("add", {}).items():
                if x["table"] == table and x["kind"] == "delta":
                    paths += [f"{self.root}/{folder}/_part={p}" for p in x["parts"]]
        if not paths:
            return None, now.version
        rows = self.spark.read.schema(schema_of(table) + ", _gone boolean").parquet(*paths)
        return rows.filter("not _gone").drop("_gone"), now.version

    @contextlib.contextmanager
    def transaction(self, name: str | None = None) -> Iterator[Transaction]:
        """Changes that become visible together; raises :class:`Conflict` where another writer changed what they were worked out from. A ``name`` is committed once only."""
        own = Transaction(self, name)
        try:
            yield own
            state = own.commit()
        except BaseException:
            own.abandon()
            raise
        if name and own.add and not set(own.add) & set(state.live):
            own.abandon()  # committed by an earlier run
        self._tidy(state, {x["table"] for x in own.add.values()})

    def _again(self, change: Callable[[Transaction], None], name: str | None = None) -> None:
        """One change, worked out anew as long as other writers spoil it."""
        for attempt in range(self.ATTEMPTS):
            try:
                with self.transaction(name) as t:
                    change(t)
                return
            except Conflict:
                if attempt + 1 == self.ATTEMPTS:
                    raise

    def append(self, table: str, rows: DataFrame, *, name: str | None = None) -> None:
        self._again(lambda t: t.append(table, rows), name)

    def upsert(self, table: str, rows: DataFrame, *, how: str = "last", fill: list[str] | None = None, order: Column | None = None, name: str | None = None) -> None:
        self._again(lambda t: t.upsert(table, rows, how=how, fill=fill, order=order), name)

    def set(self, table: str, id: str, **fields) -> None:
        self._again(lambda t: t.set(table, id, **fields))

    def delete(self, table: str, gone: DataFrame) -> None:
        self._again(lambda t: t.delete(table, gone))

    def replace(self, table: str, rows: DataFrame, groups: DataFrame) -> None:
        self._again(lambda t: t.replace(table, rows, groups))

    def write(self, table: str, rows: DataFrame) -> None:
        self._again(lambda t: t.write(table, rows))

    def _tidy(self, state: State, tables: set[str]) -> None:
        for table in tables:
            if sum(x["table"] == table and x["kind"] == "delta" for x in state.live.values()) > self.most_deltas:
                with contextlib.suppress(Conflict):  # a later change will
                    self.compact(table)

    def compact(self, table: str) -> None:
        own = Transaction(self)
        own.compact(table)
        own.commit()

    def vacuum(self, table: str, *, keep: int = 0) -> int:
        """Delete the folders of a table that commits up to ``keep`` before the latest took out; versions before that can't be read any more."""
        now = self.log.state()
        after = max(1, now.version - keep)
        needed = set(now.live)
        for v in range(after, now.version):
            needed |= set(self.log.state(v).live)
        gone = set()
        for v in range(1, after + 1):
            entry = self.log.entry(v)
            gone |= {f for f in [*entry.get("remove", []), *entry.get("shrink", {})] if f.split("/")[0] == table} - needed
        for folder in gone:
            self.log.files.delete(f"{self.root}/{folder}")
        return len(gone)

    @contextlib.contextmanager
    def scratch(self) -> Iterator[str]:
        """A folder beside the tables, for what is worked out once and read several times; it is deleted at the end."""
        path = f"{self.root}/_scratch/{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            self.log.files.delete(path)

    def duplicates(self, table: str) -> DataFrame:
        """Keys that occur more than once: empty for a sound table."""
        return self.read(table).groupBy(*keys(table)).count().filter("count > 1")


@functools.lru_cache(maxsize=None)
def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _null(field):
    return F.lit(None).cast(field.dataType).alias(field.name)
