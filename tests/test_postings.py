"""The stored lexical index against scoring all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathomline.operators import lexical, postings

FIELDS = {"title": 5, "text": 1}
SCHEMA = "id long, title string, text string, kind string"


def rows(seed, ids):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(1, 400), rng.randrange(1, 400), rng.randrange(1, 400))}"
    out = []
    for i in ids:
        text = " ".join(word() for _ in range(rng.randrange(0, 80)))
        out.append((i, " ".join(word() for _ in range(rng.randrange(0, 6))), None if i % 17 == 3 else text, f"k{i % 3}"))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    index = postings.LexicalIndex(spark, root, postings.Layout(("title", "text"), ("kind",), buckets=4, window_docs=16))
    first, second = rows(1, range(0, 260, 2)), rows(2, range(1, 90, 2))
    index.add(spark.createDataFrame(first, SCHEMA), name="first")
    index.add(spark.createDataFrame(second, SCHEMA), name="second")
    return index, spark.createDataFrame(first + second, SCHEMA).cache()


QUERIES = [[["w1"]], [["w3"], ["w390"], ["w7"]], [["w2"], ["w2"], ["w11"]], [["w1", "w2"]], [["w1", "w1"], ["w5"]], [["w4"], ["nothing"]], [["nothing"]], [["w9", "w1", "w3"], ["w120"]], [["w300"], ["w301"], ["w302"], ["w303"]], [[], ["w5"]], [[]]]


def same(index, table, items, **how):
    limit = how.pop("limit", 7)
    every, keep = how.get("every", False), how.get("keep")
    got = [(r["id"], r["score"]) for r in index.search(items, FIELDS, limit=limit, every=every, keep=keep).collect()]
    found = lexical.search(table, FIELDS, items, id="id", limit=limit, every=every, keep=keep)
    want = [(r["id"], r["score"]) for r in found.collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("items", QUERIES)
def test_equal_to_a_scan(built, items):
    same(*built, items)
    same(*built, items, keep=F.col("kind") == "k1", limit=100)


@pytest.mark.parametrize("items", [[["w1"], ["w2"]], [["w1"], ["w2"], ["w3"], ["w1"]], [["w1"], ["nothing"]], [["w1"], []], [["w1", "w2"], ["w3"]]])
def test_every_item(built, items):
    same(*built, items, every=True)


def test_only_and_weights(built, spark):
    index, table = built
    some = spark.createDataFrame([("k2",)], "kind string")
    got = index.search([["w1"], ["w2"]], {"text": 2.0}, limit=50, only=some).collect()
    want = lexical.search(table, {"title": 0, "text": 2.0}, [["w1"], ["w2"]], id="id", limit=50, keep=F.col("kind") == "k2").collect()
    assert [(r["id"], r["kind"]) for r in got] == [(r["id"], "k2") for r in want]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            index.search([["w1"]], FIELDS, limit=bad)


def test_reads_the_asked_words_only(built):
    index, _ = built
    blocks = index.postings(["w1", "w200"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*In\(term", plan)
    buckets = set(index.bucket_of(["w1", "w200"]))
    assert buckets < set(range(4))
    narrow = blocks.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "pos:" not in narrow and "tf:" not in narrow


def test_blocks_are_skipped(spark, tmp_path):
    """Of many windows with one frequent word only those are scored that can hold a best document."""
    index = postings.LexicalIndex(spark, str(tmp_path), postings.Layout(("text",), (), buckets=2, window_docs=8))
    texts = [(i, ("common " * (30 if i in (5, 77) else i % 3 == 2) + " filler" * 40)) for i in range(400)]
    index.add(spark.createDataFrame(texts, "id long, text string"))
    seen = []
    plain = index._exploded
    index._exploded = lambda blocks, more: seen.append(blocks) or plain(blocks, more)
    assert {r["id"] for r in index.search([["common"]], {"text": 1}, limit=2).collect()} == {5, 77}
    assert seen[-1].count() <= 2 < index.postings(["common"]).count()


def test_increments_and_merge(built, spark, tmp_path):
    index = postings.LexicalIndex(spark, str(tmp_path), postings.Layout(("title", "text"), ("kind",), buckets=4, window_docs=16))
    assert index.search([["w1"]], FIELDS, limit=5).count() == 0 and index.statistics()["documents"] == 0
    assert index.add(spark.createDataFrame([], SCHEMA))["documents"] == 0
    parts = [rows(k, range(k * 100, k * 100 + n)) for k, n in enumerate((3, 9, 1, 40))]
    for k, part in enumerate(parts):
        index.add(spark.createDataFrame(part, SCHEMA), name=f"load {k}")
        so_far = spark.createDataFrame([r for p in parts[: k + 1] for r in p], SCHEMA)
        same(index, so_far, [["w1"], ["w2", "w1"], ["w8"]])
    assert index.add(spark.createDataFrame(parts[0], SCHEMA), name="load 0")["documents"] == 0
    before = index.statistics()
    assert index.merge() == 3 and index.statistics() == before | {"segments": 2} and index.merge() == 0
    same(index, so_far, [["w1"], ["w2", "w1"], ["w8"]], limit=60)
    same(index, so_far, [["w1"], ["w4"]], every=True, limit=60)


def test_many_queries(built, spark):
    index, table = built
    asked = spark.createDataFrame([(1, "w1 w2 w2 nothing"), (2, "w7"), (3, ""), (4, None), (5, "w300 w20 w1")], "q long, words string")
    one = postings.LexicalIndex(spark, index.root + "-one", postings.Layout(("text",), (), buckets=4, window_docs=16))
    one.add(table)
    got = {(r["query_id"], r["id"], r["rank"]) for r in one.search_many(asked, "q", "words", field="text", top=5).collect()}
    want = {(r["query_id"], r["id"], r["rank"]) for r in lexical.search_many(table, "text", "id", asked, "q", "words", top=5).collect()}
    assert got == want and len(got) == 15
