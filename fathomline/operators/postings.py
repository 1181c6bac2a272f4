"""A lexical index that is kept on disk: weighted BM25 and phrases without reading the texts again.

Layout. Documents are dealt to *windows* of about ``window_docs`` by the hash of their identifier and numbered inside. A row of the postings table is one block: a term in a window, with the
numbers of the documents that hold it (relative to the window, so that they stay small and Parquet packs them), their lengths, term counts by field and positions, and beside them the
largest count by field and the smallest length. Rows lie in folders by the hash of their term (``bucket``) and are sorted by term, so that a search opens the folders of its words only and
skips row groups there.

Segments. ``add`` writes the new rows as a segment of their own and makes it visible by one commit of the log; nothing is rebuilt. Statistics are sums over segments. ``merge`` packs the windows
of small segments anew. Rows are never changed: what is indexed stays as it was.

Search. The blocks' largest counts and smallest lengths bound the score of any document of a window. The windows with the best bounds are scored first; the last of the best
scores found there rules out all windows whose bound is lower, so that their postings are not read. The result is the same as that of scoring everything. Phrases
need their number of matches for their weight, so that all windows that hold all words of a phrase are looked at.

Scores, ties and statistics are those of :mod:`fathomline.operators.lexical`.

Defined cases: null texts are empty; identifiers are distinct and not null; an item without a word matches nothing; a word that no document holds matches nothing; an empty index gives no rows."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.text import words
from fathomline.operators.lexical import B, FLOOR, K1, idf
from fathomline.sources.log import CommitLog, State
from fathomline.sources.shared import shuffles_dropped

#: Positions of a field start at its number times this; a text of more words is refused.
FIELD = 1 << 27
PLACE = ["seg", "window", "doc"]
#: Windows that are scored to find what the others have to reach.
FIRST_WINDOWS = 8
#: Documents that are handed to Python at once, and words that are inverted at once.
BATCH, MOST_WORDS = 256, 1 << 22
BLOCK = "term string, window int, n int, top array<int>, short int, doc array<int>, len array<int>, tf array<array<int>>, pos array<array<int>>"


@dataclass(frozen=True)
class Layout:
    fields: tuple[str, ...]
    keep: tuple[str, ...] = ()
    buckets: int = 16
    window_docs: int = 4096


class LexicalIndex:
    """An index below ``root`` of tables with the columns ``id``, ``layout.fields`` and ``layout.keep`` (what results show and filters name).

    ``analyzer`` turns a column of text into an array of terms; texts and queries must go through the same."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout, id: str = "id", analyzer=words) -> None:
        self.spark, self.root, self.layout, self.id, self.analyzer = spark, root.rstrip("/"), layout, id, analyzer
        self.log = CommitLog(spark, self.root)

    # writing

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.layout.buckets)).cast("int")

    def bucket_of(self, terms: list[str]) -> list[int]:
        """The folders that hold these terms."""
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)

    def add(self, rows: DataFrame, *, name: str | None = None, settings: dict | None = None) -> dict:
        """Index ``rows``; with a ``name`` that was added before, nothing happens. ``settings`` are kept with the commit."""
        state = self.log.state()
        if name and name in state.names:
            return {"segment": None, "documents": 0}
        n = rows.count()
        if not n:
            return {"segment": None, "documents": 0}
        windows = -(-n // self.layout.window_docs)
        texts = [F.col(f).alias(f"__t{k}") for k, f in enumerate(self.layout.fields)]
        window = F.pmod(F.xxhash64("id"), F.lit(windows)).cast("int")
        terms = [self.analyzer(F.col(f"__t{k}")).alias(f"__t{k}") for k in range(len(texts))]
        size = lambda k: F.when(F.size(f"__t{k}") <= FIELD, F.size(f"__t{k}")).otherwise(F.raise_error(F.lit("a text has more words than the index can hold")).cast("int"))
        length = reduce(lambda a, b: a + b, [size(k) for k in range(len(texts))])
        docs = rows.select(F.col(self.id).alias("id"), *self.layout.keep, *texts).select("id", *self.layout.keep, *terms).select("id", *self.layout.keep, length.alias("len")).withColumn("window", window)
        # numbered by identifier inside a window, here and where the postings are made: only the texts travel, once, and no row for a word
        docs = docs.repartition("window").withColumn("doc", F.row_number().over(Window.partitionBy("window").orderBy("id")) - 1)
        own = rows.select(F.col(self.id).alias("id"), *texts).withColumn("window", window).repartition("window").sortWithinPartitions("window", "id").select("window", *terms)
        segment = uuid.uuid4().hex
        with shuffles_dropped(self.spark):
            self._write_docs(docs.select("window", "doc", "id", "len", *self.layout.keep), segment)
            with _set(self.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)), _set(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(self.layout.buckets)):
                # a window's blocks come by term; a file for each bucket stays open, so that nothing is sorted for the writing
                blocks = own.mapInArrow(partial(_inverted, fields=len(texts)), BLOCK).withColumn("bucket", self._bucket(F.col("term")))
                blocks.write.partitionBy("bucket").parquet(f"{self.root}/postings/seg={segment}")
        self._commit(segment, n, state, name, [], settings)
        return {"segment": segment, "documents": n}

    def _write_docs(self, docs: DataFrame, segment: str) -> None:
        docs.sortWithinPartitions("window", "doc").write.parquet(f"{self.root}/docs/seg={segment}")

    def _write_postings(self, by_doc: DataFrame, segment: str, windows: int) -> None:
        """by_doc(window, doc, len, term, pos): a row of blocks for each term and window."""
        counts = F.array(*[F.size(_in_field(F.col("pos"), k)) for k in range(len(self.layout.fields))])
        one = F.struct("doc", "len", counts.alias("tf"), "pos")
        blocks = by_doc.groupBy("window", "term").agg(F.sort_array(F.collect_list(one)).alias("x"))
        top = F.array(*[F.array_max(F.transform(_member(F.col("x"), "tf"), _item(k))) for k in range(len(self.layout.fields))])
        rows = blocks.select(
            "term",
            "window",
            F.size("x").alias("n"),
            top.alias("top"),
            F.array_min(_member(F.col("x"), "len")).alias("short"),
            *[_member(F.col("x"), c).alias(c) for c in ("doc", "len", "tf", "pos")],
            self._bucket(F.col("term")).alias("bucket"),
        )
        # a bucket is written by as many tasks as it has hundreds of windows, so that no frequent term makes one task long
        spread = F.pmod(F.col("window"), F.lit(max(1, windows // 128)))
        rows.repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{self.root}/postings/seg={segment}")

    def _commit(self, segment: str, n: int, base: State, name: str | None, merged: list[str], settings: dict | None = None) -> None:
        total = self.spark.read.parquet(f"{self.root}/docs/seg={segment}").agg(F.sum("len")).first()[0]
        entry = {"add": {segment: {"documents": n, "length": total}}, "remove": merged, "settings": settings or {}} | ({"name": name} if name else {})
        # segments are independent; only a merge of the same ones is spoilt by another merge
        self.log.commit(entry, base, lambda other: bool(set(other.get("remove", [])) & set(merged)))

    def merge(self, most_documents: int | None = None) -> int:
        """Pack the segments of at most so many documents (by default a window's) into one; the number of segments that went."""
        state = self.log.state()
        most = self.layout.window_docs if most_documents is None else most_documents
        small = [s for s, x in state.live.items() if x["documents"] <= most]
        if len(small) < 2:
            return 0
        n = sum(state.live[s]["documents"] for s in small)
        windows = -(-n // self.layout.window_docs)
        docs = self._table("docs", small)
        docs = docs.withColumnsRenamed({"window": "old_window", "doc": "old_doc"}).withColumn("window", F.pmod(F.xxhash64("id"), F.lit(windows)).cast("int"))
        docs = docs.withColumn("doc", F.row_number().over(Window.partitionBy("window").orderBy("id", "seg")) - 1)
        segment = uuid.uuid4().hex
        moved = f"{self.root}/_scratch/{segment}"
        try:
            # read twice: the numbers must be the same for both
            docs.write.parquet(moved)
            docs = self.spark.read.parquet(moved)
            self._write_docs(docs.select("window", "doc", "id", "len", *self.layout.keep), segment)
            old = self._exploded(self._table("postings", small), ["pos"]).withColumnsRenamed({"window": "old_window", "doc": "old_doc"})
            self._write_postings(old.join(docs.select("seg", "old_window", "old_doc", "window", "doc"), ["seg", "old_window", "old_doc"]).select("window", "doc", "len", "term", "pos"), segment, windows)
        finally:
            self.log.files.delete(moved)
        self._commit(segment, n, state, None, small)
        return len(small)

    # reading

    def _table(self, kind: str, segments: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/seg={s}" for s in segments])

    def postings(self, terms: list[str], state: State | None = None) -> DataFrame:
        """The blocks of these terms; other folders are not opened."""
        state = state or self.log.state()
        return self._table("postings", list(state.live)).filter(F.col("bucket").isin(self.bucket_of(terms)) & F.col("term").isin(terms))

    @staticmethod
    def _exploded(blocks: DataFrame, more: list[str]) -> DataFrame:
        """One row for each document of a block."""
        columns = ["doc", "len", *more]
        return blocks.select("seg", "window", "term", F.explode(F.arrays_zip(*columns)).alias("x")).select("seg", "window", "term", *[F.col(f"x.{c}").alias(c) for c in columns])

    def statistics(self) -> dict:
        """Documents, mean length and segments."""
        live = self.log.state().live
        n = sum(x["documents"] for x in live.values())
        return {"documents": n, "mean_length": sum(x["length"] for x in live.values()) / n if n else 0.0, "segments": len(live)}

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string, score double")

    def search(self, items: list[list[str]], weights: dict[str, float], *, limit: int, every: bool = False, keep: Column | None = None, only: DataFrame | None = None) -> DataFrame:
        """(id, kept columns, score) of the best ``limit`` documents, ties by identifier. ``keep`` and ``only`` (a semi-join on its columns) hold after scoring."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be between 1 and 100")
        found = self.scored(items, weights, every=every, keep=keep, only=only, best=limit)
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def scored(self, items: list[list[str]], weights: dict[str, float], *, every: bool = False, keep: Column | None = None, only: DataFrame | None = None, best: int | None = None) -> DataFrame:
        """All matching documents with their rounded scores; with ``best``, those that may be among so many."""
        state = self.log.state()
        if every and not all(items):
            items = []
        items = [i for i in items if i]
        if not items or not state.live:
            return self._shown(None, state, keep, only)
        n = sum(x["documents"] for x in state.live.values())
        average = sum(x["length"] for x in state.live.values()) / n
        asked = sorted({w for i in items for w in i})
        weight = [float(weights.get(f, 0.0)) for f in self.layout.fields]
        blocks = self.postings(asked, state)
        if any(len(i) > 1 for i in items):
            return self._shown(self._phrases(blocks, items, asked, weight, n, average, every), state, keep, only)
        of = lambda counts: reduce(lambda a, b: a + b, [F.lit(w) * counts[k] for k, w in enumerate(weight)])
        # a field of no weight doesn't make a document match
        matching = blocks.select("term", "n") if all(weight) else self._exploded(blocks, ["tf"]).filter(of(F.col("tf")) > 0).select("term", F.lit(1).alias("n"))
        df = {r["term"]: r["n"] for r in matching.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        items = [i[0] for i in items]
        if not df or (every and len(df) < len(asked)):
            return self._shown(None, state, keep, only)
        times = {t: items.count(t) for t in df}
        value = F.create_map(*[F.lit(x) for t, k in df.items() for x in (t, _weight(n, k) * times[t])])
        factor = F.element_at(value, F.col("term"))
        saturated = lambda f, length: f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))
        highest = of(F.col("top"))
        bounds = blocks.filter(highest > 0).select("seg", "window", "term", (factor * saturated(highest, F.col("short"))).alias("bound")).groupBy("seg", "window").agg(F.sum("bound").alias("bound"), F.count_distinct("term").alias("terms"))
        if every:
            bounds = bounds.filter(F.col("terms") == len(asked))

        def score(part: DataFrame) -> DataFrame:
            f = of(F.col("tf"))
            each = self._exploded(part, ["tf"]).withColumn("f", f).filter("f > 0")
            total = each.withColumn("s", factor * saturated(F.col("f"), F.col("len"))).groupBy(*PLACE).agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("terms"))
            total = total.filter(F.col("terms") == len(asked)) if every else total
            return total.select(*PLACE, F.round("s", 6).alias("score"))

        if best is None:
            return self._shown(score(blocks), state, keep, only)
        first = bounds.orderBy(F.desc("bound"), "seg", "window").limit(FIRST_WINDOWS).collect()
        if not first:
            return self._shown(None, state, keep, only)
        here = reduce(lambda a, b: a | b, [(F.col("seg") == r["seg"]) & (F.col("window") == r["window"]) for r in first])
        lead = [r["score"] for r in self._shown(score(blocks.filter(here)), state, keep, only).select("score").orderBy(F.desc("score")).limit(best).collect()]
        # a rounded score can be above its bound by half a millionth
        wanted = bounds.filter(F.col("bound") >= lead[-1] - 6e-7) if len(lead) == best else bounds
        return self._shown(score(blocks.join(wanted.select("seg", "window"), ["seg", "window"], "left_semi")), state, keep, only)

    def _phrases(self, blocks: DataFrame, items: list[list[str]], asked: list[str], weight: list[float], n: int, average: float, every: bool) -> DataFrame:
        """(place, score) with the counts of phrases from positions."""
        # only windows with all words of an item can match it
        inside = blocks.select("seg", "window", "term").groupBy("seg", "window").agg(F.collect_set("term").alias("has"))
        whole = reduce(lambda a, b: a | b, [F.size(F.array_intersect("has", F.array(*map(F.lit, set(i))))) == len(set(i)) for i in items])
        near = blocks.join(inside.filter(whole).select("seg", "window"), ["seg", "window"], "left_semi")
        docs = self._exploded(near, ["pos"]).groupBy(*PLACE, "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("m"))
        none = F.array().cast("array<int>")

        def count(item: list[str]) -> Column:
            at = [F.coalesce(F.element_at("m", F.lit(w)), none) for w in item]
            hits = reduce(F.array_intersect, [_shifted(a, k) for k, a in enumerate(at)])
            return reduce(lambda a, b: a + b, [F.lit(w) * F.size(_in_field(hits, k)) for k, w in enumerate(weight)])

        counted = docs.select(*PLACE, "len", F.array(*[count(i) for i in items]).alias("tf"))
        df = counted.agg(*[F.count_if(F.col("tf")[k] > 0).alias(str(k)) for k in range(len(items))]).first()
        parts = [F.lit(_weight(n, df[str(k)])) * F.col("tf")[k] * (K1 + 1) / (F.col("tf")[k] + K1 * (1 - B + B * F.col("len") / average)) for k in range(len(items))]
        hits = reduce(lambda a, b: a + b, [(F.col("tf")[k] > 0).cast("int") for k in range(len(items))])
        return counted.filter(hits >= (len(items) if every else 1)).select(*PLACE, F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))

    def _shown(self, hits: DataFrame | None, state: State, keep: Column | None, only: DataFrame | None) -> DataFrame:
        """Hits by place -> (id, kept columns, score)."""
        if not state.live:
            return self._none()
        docs = self._table("docs", list(state.live))
        if hits is None:
            return docs.select("id", *self.layout.keep, F.lit(0.0).alias("score")).filter(F.lit(False))
        shown = hits.join(docs.drop("len"), PLACE)
        if keep is not None:
            shown = shown.filter(keep)
        if only is not None:
            shown = shown.join(only, only.columns, "left_semi")
        return shown.select("id", *self.layout.keep, "score")

    def search_many(self, queries: DataFrame, query_id: str, query: str, *, field: str, top: int) -> DataFrame:
        """For each row of ``queries`` its ``top`` documents by one field, all words of the query counted: query_id, id, score, rank. Blocks of words that no query has are left out where they are read."""
        state = self.log.state()
        if not state.live:
            return self.spark.createDataFrame([], "query_id string, id string, score double, rank int")
        n = sum(x["documents"] for x in state.live.values())
        average = sum(x["length"] for x in state.live.values()) / n
        k = self.layout.fields.index(field)
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(self.analyzer(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        terms = asked.select("term", self._bucket(F.col("term")).alias("bucket")).distinct()
        blocks = self._table("postings", list(state.live)).join(terms, ["bucket", "term"], "left_semi").filter(F.col("top")[k] > 0)
        df = blocks.groupBy("term").agg(F.sum("n").alias("df")) if len(self.layout.fields) == 1 else self._exploded(blocks, ["tf"]).filter(F.col("tf")[k] > 0).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # a window's blocks meet in one place, where each query adds up its words; the best of each window are all that leaves it
        who = asked.groupBy("term").agg(F.collect_list("query_id").alias("queries"), F.collect_list("times").alias("times"))
        weighed = blocks.join(df.withColumn("idf", idf(F.lit(n), F.col("df"))), "term").join(who, "term")
        weighed = weighed.select("seg", "window", "doc", "len", F.transform("tf", _item(k)).alias("f"), "idf", "queries", "times")
        kind = queries.schema[query_id].dataType.simpleString()
        total = weighed.groupBy("seg", "window").applyInArrow(lambda part: _best_of_window(part, average, top), f"query_id {kind}, seg string, window int, doc int, score double")
        total = total.withColumn("score", F.round("score", 6))
        shown = total.join(self._table("docs", list(state.live)).select(*PLACE, "id"), PLACE)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return shown.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "id", "score", "rank")


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _inverted(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """Documents (window, terms of each field), ordered by window and identifier -> blocks. A window of very many words has several blocks of a term, each of documents of its own."""
    window, docs, held, numbers, parts, lengths = None, 0, 0, {}, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, numbers, parts
        if held:
            yield _blocks(window, fields, list(numbers), *(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(lengths))
        held, numbers, parts = 0, {}, []

    for batch in batches:
        places = batch.column(0).to_numpy()
        ends = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1 + k)), 0).to_numpy())]) for k in range(fields)]
        words = [batch.column(1 + k).flatten().dictionary_encode() for k in range(fields)]
        at = 0
        while at < len(places):
            if places[at] != window:
                yield from flush()
                window, docs, lengths = places[at], 0, []
            # as many documents as the window has here and as a block should hold
            end = at + int(np.searchsorted(places[at:], window, side="right"))
            sizes = sum(np.diff(e) for e in ends)[at:end]
            fits = int(np.searchsorted(np.cumsum(sizes), MOST_WORDS - held, side="right"))
            end = at + max(min(fits, end - at), 0 if held else 1)
            if end == at:
                yield from flush()
                continue
            lengths.append(sizes[: end - at].astype(np.int32))
            for k in range(fields):
                lo, hi = ends[k][at], ends[k][end]
                if lo == hi:
                    continue
                own = words[k].indices.to_numpy()[lo:hi]
                used, own = np.unique(own, return_inverse=True)
                terms = words[k].dictionary.take(pa.array(used)).to_pylist()
                known = np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int32)
                each = np.diff(ends[k][at : end + 1])
                doc = np.repeat(np.arange(docs, docs + end - at, dtype=np.int32), each)
                pos = np.arange(lo, hi) - np.repeat(ends[k][at:end], each) + k * FIELD
                parts.append((known[own], doc, pos.astype(np.int32)))
                held += int(hi - lo)
            docs, at = docs + end - at, end
    yield from flush()


def _blocks(window: int, fields: int, terms: list[str], term: np.ndarray, doc: np.ndarray, pos: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """One block for each term; a row of the arrays is a word of a document."""
    names = pa.array(terms, pa.string())
    ordered = pc.sort_indices(names)
    rank = np.empty(len(terms), np.int32)
    rank[ordered.to_numpy()] = np.arange(len(terms), dtype=np.int32)
    term = rank[term]
    order = np.lexsort((pos, doc, term))
    term, doc, pos = term[order], doc[order], pos[order]
    pairs = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
    of_pair, doc = term[pairs], doc[pairs]
    first = np.flatnonzero(np.concatenate([[True], of_pair[1:] != of_pair[:-1]]))
    field = pos // FIELD
    tf = np.stack([np.add.reduceat((field == k).astype(np.int32), pairs) for k in range(fields)], axis=1)
    length = lengths[doc]
    edges = pa.array(np.concatenate([first, [len(pairs)]]).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(edges, values)
    fixed = lambda table: pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * fields), pa.array(table.astype(np.int32).ravel()))
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([pairs, [len(pos)]]).astype(np.int32)), pa.array(pos))
    return pa.RecordBatch.from_pydict(
        {
            "term": names.take(ordered),
            "window": pa.array(np.full(len(first), window, np.int32)),
            "n": pa.array(np.diff(np.concatenate([first, [len(pairs)]])).astype(np.int32)),
            "top": fixed(np.maximum.reduceat(tf, first, axis=0)),
            "short": pa.array(np.minimum.reduceat(length, first).astype(np.int32)),
            "doc": lists(pa.array(doc)),
            "len": lists(pa.array(length)),
            "tf": lists(fixed(tf)),
            "pos": lists(places),
        }
    )


def _best_of_window(blocks: pa.Table, average: float, top: int) -> pa.Table:
    """Blocks of one window with their weight and the queries that ask for them -> of each query the documents that may be among its best ``top``."""
    parts, asks = [], {}
    docs = 0
    queries, times = blocks.column("queries").to_pylist(), blocks.column("times").to_pylist()
    for i, weight in enumerate(blocks.column("idf").to_pylist()):
        doc, length, f = (blocks.column(c)[i].values.to_numpy() for c in ("doc", "len", "f"))
        doc, length, f = doc[f > 0], length[f > 0], f[f > 0].astype(float)
        parts.append((doc, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))))
        docs = max(docs, int(doc.max()) + 1 if len(doc) else 0)
        for q, n in zip(queries[i], times[i], strict=True):
            asks.setdefault(q, []).append((i, n))
    out = []
    for q, wanted in asks.items():
        score, met = np.zeros(docs), np.zeros(docs, bool)
        for i, n in wanted:
            doc, part = parts[i]
            score[doc] += part * n
            met[doc] = True
        hits = np.flatnonzero(met)
        if len(hits) > top:
            # what is as good as the last of the best after rounding stays
            reach = -np.partition(-score[hits], top - 1)[top - 1]
            hits = hits[score[hits] >= reach - 1.1e-6]
        out.append((q, hits.astype(np.int32), score[hits]))
    size = [len(h) for _, h, _ in out]
    place = blocks.slice(0, 1)
    names = pa.array([q for q, _, _ in out], blocks.schema.field("queries").type.value_type).take(pa.array(np.repeat(np.arange(len(out)), size)))
    fill = lambda c: pa.array([place.column(c)[0].as_py()] * sum(size), blocks.schema.field(c).type)
    doc, score = (pa.array(np.concatenate([x[c] for x in out])) for c in (1, 2))
    return pa.table({"query_id": names, "seg": fill("seg").cast(pa.string()), "window": fill("window").cast(pa.int32()), "doc": doc, "score": score})


def _in_field(positions: Column, field: int) -> Column:
    return F.filter(positions, lambda p: (p >= field * FIELD) & (p < (field + 1) * FIELD))


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _member(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def _item(k: int):
    return lambda x: x[k]


def _weight(total: int, matching: int) -> float:
    import math

    raw = math.log((total - matching + 0.5) / (matching + 0.5))
    return raw if raw > 0 else FLOOR
