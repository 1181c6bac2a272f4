"""Readers of outside files: whole texts, binary artifacts, chat histories, catalog entries; and the content-addressed sink."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import squeeze
from fathomline.sources.log import Files


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text), bytes that aren't UTF-8 replaced."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("uri"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, content_hash, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("uri"), F.sha2("content", 256).alias("content_hash"), "length", "content")


STORED = "content_hash string, content binary, shard string"


def stored_artifacts(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    """(content_hash, content, shard) of a namespace, empty before its first put."""
    path = f"{root}/{namespace}"
    return spark.read.schema(STORED).parquet(path) if Files(spark).exists(path) else spark.createDataFrame([], STORED)


def put_artifacts(rows: DataFrame, root: str, namespace: str) -> DataFrame:
    """Write (content) rows once per content, in folders by the first two digits of the hash; returns (content_hash, artifact_uri).

    What is stored already is read from the folders concerned only, and is checked: a content that no longer has its hash raises. A repeated put writes nothing."""
    spark = rows.sparkSession
    hashed = rows.select(F.sha2("content", 256).alias("content_hash"), "content").withColumn("shard", F.substring("content_hash", 1, 2)).dropDuplicates(["content_hash"]).persist()
    try:
        shards = [r["shard"] for r in hashed.select("shard").distinct().collect()]  # 256 at most
        stored = stored_artifacts(spark, root, namespace).filter(F.col("shard").isin(shards))
        known = stored.join(hashed.select("shard", "content_hash"), ["shard", "content_hash"], "left_semi")
        broken = [r["content_hash"] for r in verified(known).select("content_hash").limit(5).collect()]
        if broken:
            raise ValueError(f"stored artifacts are damaged: {', '.join(broken)}")
        fresh = hashed.join(stored.select("shard", "content_hash"), ["shard", "content_hash"], "left_anti").select("content_hash", "content", "shard")
        if not fresh.isEmpty():
            fresh.write.mode("append").partitionBy("shard").parquet(f"{root}/{namespace}")
    finally:
        hashed.unpersist()
    return hashed.select("content_hash", F.concat_ws("/", F.lit(root), F.lit(namespace), F.concat(F.lit("shard="), "shard"), "content_hash").alias("artifact_uri"))


def verified(stored: DataFrame) -> DataFrame:
    """Artifacts whose content no longer has its hash."""
    return stored.filter(F.sha2("content", 256) != F.col("content_hash"))


def read_artifact(spark: SparkSession, root: str, namespace: str, content_hash: str) -> bytes:
    """The content with a hash, checked; KeyError where it isn't stored. A name that is no hash can't lead out of the namespace: it is refused."""
    if not re.fullmatch("[0-9a-f]{64}", content_hash) or not re.fullmatch("[A-Za-z0-9_-]+", namespace):
        raise ValueError("an artifact is named by its SHA-256 and a plain namespace")
    row = stored_artifacts(spark, root, namespace).filter((F.col("shard") == content_hash[:2]) & (F.col("content_hash") == content_hash)).limit(1).first()
    if row is None:
        raise KeyError(f"Unknown artifact: {content_hash}")
    if hashlib.sha256(row["content"]).hexdigest() != content_hash:
        raise ValueError(f"stored artifacts are damaged: {content_hash}")
    return bytes(row["content"])


PAGES = "uri string, content_hash string, pages array<struct<page:int,text:string>>, error string"


def pdf_pages(files: DataFrame, extract) -> DataFrame:
    """files(uri, content) -> :data:`PAGES`, a row for each file: its pages, or what went wrong with it.

    ``extract(bytes)`` gives (page, text) pairs; it runs where the files lie, a file at a time, so that a broken one fails alone. Characters that UTF-8 can't hold become ``?``."""

    def run(batches):
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    body = content.as_py() or b""
                    if not body.startswith(b"%PDF"):
                        raise ValueError("the file is no PDF")
                    pages = [{"page": int(n), "text": str(t).encode("utf-8", "replace").decode()} for n, t in extract(body)]
                    out.append((pages, None if any(p["text"].strip() for p in pages) else "the file has no text"))
                except Exception as error:  # noqa: BLE001  a file's failure is its result
                    out.append((None, f"{type(error).__name__}: {error}"[:1000]))
            kind = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["uri"], batch["content_hash"], pa.array([p if e is None else None for p, e in out], kind), pa.array([e for _, e in out], pa.string())], names=["uri", "content_hash", "pages", "error"])

    return files.select("uri", F.sha2("content", 256).alias("content_hash"), "content").mapInArrow(run, PAGES)


def history_lines(spark: SparkSession, path: str) -> DataFrame:
    """(uri, observed_at, pos, value) of JSON-lines chat files, with the time the file was last changed."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(path)
    files = raw.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_modification_time").alias("observed_at"), F.sha2("value", 256).alias("digest"), "value")
    return files.select("uri", "observed_at", "digest", F.posexplode(F.split("value", "\n")).alias("pos", "value"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest isn't the stored one."""
    return files.join(known.select("uri", "digest"), ["uri", "digest"], "left_anti")


ENTRY = "struct<id:string, title:string, summary:string, published:string, updated:string, author:array<struct<name:string>>, category:array<struct<_term:string>>, primary_category:struct<_term:string>, link:array<struct<_href:string, _title:string, _rel:string>>>"


def catalog_entries(feeds: DataFrame, column: str = "value") -> DataFrame:
    """Catalog rows of Atom entries, one ``<entry>`` a row, namespaces removed."""
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r"(</?)[A-Za-z]+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    e = feeds.select(F.from_xml(plain, _entry_schema()).alias("e"))
    pdf = F.get(F.transform(F.filter("e.link", lambda x: x["_title"] == "pdf"), lambda x: x["_href"]), F.lit(0))
    return e.select(
        F.regexp_extract("e.id", r"abs/(.+)$", 1).alias("source_id"),
        squeeze(F.col("e.title")).alias("title"),
        squeeze(F.col("e.summary")).alias("abstract"),
        F.transform("e.author", lambda a: a["name"]).alias("authors"),
        F.transform("e.category", lambda c: c["_term"]).alias("categories"),
        F.col("e.primary_category._term").alias("primary_category"),
        F.substring("e.published", 1, 10).alias("published_date"),
        F.col("e.updated").alias("updated_at"),
        F.col("e.id").alias("abstract_url"),
        pdf.alias("pdf_url"),
    )


def _entry_schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ENTRY)


def rows_as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
