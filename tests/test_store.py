"""The store of deltas: what a change writes, what two writers do to one another, reruns, compaction, time travel."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from fathomline.sources.log import CommitLog, Conflict, Files
from fathomline.sources.tables import Store

PAPERS = "id string, canonical_title string, abstract string, authors array<string>"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), parts=4, most_deltas=3)


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPERS)


def titles(store, **how):
    return {r["id"]: r["canonical_title"] for r in store.read("papers", **how).collect()}


def files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(store.root) for f in names if f.endswith(".parquet")}


def test_a_small_change_writes_a_small_delta(spark, store):
    store.append("papers", papers(spark, [(f"p{i}", f"t{i}", "", []) for i in range(200)]))
    before = files(store)
    size = sum(map(os.path.getsize, before))
    store.upsert("papers", papers(spark, [("p7", "new", "", [])]))
    fresh = files(store) - before
    assert before <= files(store) and len(fresh) == 1 and sum(map(os.path.getsize, fresh)) < size / 4
    assert titles(store)["p7"] == "new" and len(titles(store)) == 200
    some = Store(spark, store.root)._read(store.log.state(), "papers", {0}).inputFiles()
    assert some and all("_part=0" in f for f in some)


def test_rerun_changes_nothing(spark, store):
    rows = papers(spark, [("a", "x", "", []), ("b", "y", None, ["n"])])
    for how in ("last", "first", "fill"):
        store.upsert("papers", rows, how=how, fill=["abstract", "authors"])
    assert store.version == 1
    store.append("papers", papers(spark, [("c", "z", "", [])]), name="load 1")
    store.append("papers", papers(spark, [("c", "other", "", [])]), name="load 1")
    assert titles(store) == {"a": "x", "b": "y", "c": "z"}


def test_rules(spark, store):
    store.append("papers", papers(spark, [("a", "x", "", ["n"]), ("b", "y", "told", [])]))
    more = papers(spark, [("a", "new", "text", []), ("b", "new", "", ["m"]), ("c", "new", None, None)])
    store.upsert("papers", more, how="fill", fill=["abstract", "authors"])
    assert {tuple(r)[:4] for r in store.read("papers").select("id", "canonical_title", "abstract", F.array_join("authors", ",")).collect()} == {("a", "x", "text", "n"), ("b", "y", "told", "m"), ("c", "new", None, None)}
    store.upsert("papers", more, how="first")
    assert titles(store) == {"a": "x", "b": "y", "c": "new"}
    store.upsert("papers", more, how="last")
    assert set(titles(store).values()) == {"new"}
    with pytest.raises(ValueError):
        store.upsert("papers", more, how="sometimes")


def test_delete_replace_and_versions(spark, store):
    store.append("papers", papers(spark, [("a", "g1", "", []), ("b", "g1", "", []), ("c", "g2", "", [])]))
    store.delete("papers", spark.createDataFrame([("a",)], "id string"))
    assert set(titles(store)) == {"b", "c"}
    store.replace("papers", papers(spark, [("d", "g1", "", []), ("c", "g2", "", [])]), spark.createDataFrame([("g1",)], "canonical_title string"))
    assert titles(store) == {"c": "g2", "d": "g1"}
    assert set(titles(store, version=1)) == {"a", "b", "c"} and set(titles(store, version=2)) == {"b", "c"}
    store.write("papers", papers(spark, [("z", "t", "", [])]))
    assert set(titles(store)) == {"z"}
    assert store.vacuum("papers") >= 3 and set(titles(store)) == {"z"}


def test_compaction_rewrites_only_parts_with_deltas(spark, store):
    store.write("papers", papers(spark, [(f"p{i}", "t", "", []) for i in range(100)]))
    base = files(store)
    for k in range(5):  # more than most_deltas, all on one key
        store.upsert("papers", papers(spark, [("p1", f"t{k}", "", [])]))
    live = store.log.state().live
    assert sum(x["kind"] == "delta" for x in live.values()) <= 3
    assert max(len(x["parts"]) for x in live.values() if x["kind"] == "base") == 3  # the first base lost the key's part only
    assert base <= files(store) and len(titles(store)) == 100 and titles(store)["p1"] == "t4"
    for k in range(20):
        store.upsert("papers", papers(spark, [(f"p{k}", "last", "", [])]))
    assert os.path.exists(f"{store.root}/_log/000000000020.state")
    again = Store(spark, store.root)
    assert again.parts == 4 and sum(v == "last" for v in titles(again).values()) == 20 and again.duplicates("papers").isEmpty()


def test_two_writers_never_get_one_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    own = Files(spark)
    got, name = [], f"{tmp_path}/log/_log/000000000001.json"
    workers = [threading.Thread(target=lambda k=k: got.append(own.put_if_absent(name, str(k)))) for k in range(8)]
    own.system(name).mkdirs(own.path(name).getParent())
    [w.start() for w in workers], [w.join() for w in workers]
    assert sorted(got) == [False] * 7 + [True] and len(os.listdir(tmp_path / "log" / "_log")) <= 2
    assert log._numbers() == ([1], [])


def test_two_writers_of_one_key(spark, store):
    """Both read the same state; the second is refused, and the store's own methods work it out again."""
    store.append("papers", papers(spark, [("a", "x", "", [])]))
    first = store.transaction()
    t = first.__enter__()
    t.upsert("papers", papers(spark, [("a", "from the first", "said", [])]), how="fill", fill=["abstract"])
    store.upsert("papers", papers(spark, [("a", "from the second", "", ["n"])]))
    with pytest.raises(Conflict):
        first.__exit__(None, None, None)
    assert titles(store) == {"a": "from the second"} and len(store.log.state().live) == 2
    calls = []

    def change(t):
        calls.append(1)
        t.upsert("papers", papers(spark, [("a", "", "said", [])]), how="fill", fill=["abstract"])
        if len(calls) == 1:
            store.upsert("papers", papers(spark, [("a", "third", "", ["n"])]))

    store._again(change)
    row = store.read("papers").first()
    assert len(calls) == 2 and (row["canonical_title"], row["abstract"], row["authors"]) == ("third", "said", ["n"])


def test_writers_of_different_parts_pass(spark, store):
    store.append("papers", papers(spark, [(f"p{i}", "t", "", []) for i in range(40)]))
    part = {r["id"]: r["p"] for r in store.read("papers").withColumn("p", store._part("papers")).collect()}
    a = "p0"
    b = next(i for i in part if part[i] != part[a])
    with store.transaction() as t:
        t.upsert("papers", papers(spark, [(a, "one", "", [])]))
        store.upsert("papers", papers(spark, [(b, "two", "", [])]))
    assert (titles(store)[a], titles(store)[b]) == ("one", "two")


def test_tables_change_together(spark, store):
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.append("papers", papers(spark, [("a", "x", "", [])]))
        raise RuntimeError("died")
    assert store.version == 0 and not files(store)
    with store.transaction() as t:
        t.append("papers", papers(spark, [("a", "x", "", [])]))
        t.append("paper_favorites", spark.createDataFrame([("a",)], "paper_id string"))
        assert store.read("papers").isEmpty()
    assert store.version == 1 and store.read("paper_favorites").count() == 1
