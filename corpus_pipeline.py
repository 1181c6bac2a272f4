"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import exact_dedup, language_id, packing, pii, simhash
from fathomline.llm.queries import document_ids, pii_key
from fathomline.llm.storage import discard, documents, keep, scratch, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A text that is nearer than this to no learned profile is in none of their languages.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with the language predicted as ``lang``; those without text or letters, or in none of the languages, go."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit_documents(docs))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.filter(known).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the one with the smallest doc_id stays."""
    return exact_dedup.keep_first_copies(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, an exact Jaccard similarity of 0.8) the document with the smallest doc_id stays.

    A null doc_id comes last; of documents that share one, that with the smallest text hash stays; texts without a word are alike; a text without a near copy stays whatever its doc_id."""
    return simhash.keep_one_of_each(docs.select(*COLUMNS), jaccard=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    return pii.pseudonymise(docs.select(*COLUMNS), key=pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence of 1024 tokens. Null text gives the end token only; doc_ids may be null or repeat."""
    return packing.pack_documents(docs, document_ids())


STAGES = [("language", language), ("exact", exact), ("near", near), ("pii", private), ("packing", packed)]

#: Profiles, fingerprints, surrogates and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        before = docs
        with scratch():  # what a stage writes for itself goes with it, and so does what the stage read
            docs = keep(stage(function(spark, before, sf_dir), f"pipeline-{name}"))
        discard(before)
    return docs
