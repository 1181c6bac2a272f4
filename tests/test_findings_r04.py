"""What the findings of round 4 were about."""

from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomline.operators import cluster, postings, ranking


def test_recency_is_exact_and_equal_strengths_tie(spark):
    """an affinity of 2 ** -1.5 is as strong as the recency of day 270, so that their labels order them; a paper without a title comes last, as in the SQL."""
    days = spark.range(2000).withColumn("date", F.date_format(F.date_sub(F.lit("2026-01-15").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"))
    got = {r["id"]: r["recency"] for r in days.select("id", ranking.recency(F.col("date"), "2026-01-15").alias("recency")).collect()}
    with localcontext(prec=60):
        assert got == {day: float(Decimal(2) ** Decimal(-day / 180.0)) for day in range(2000)}
    # one of 12 tokens is among 6 that are liked: 3 / sqrt(72)
    text = " ".join(["liked", *[f"word{'abcdefghijk'[k]}" for k in range(11)]])
    rows = [("p1", text, "", "2025-04-20", 0.1, 3, True), ("p2", None, None, "2024-01-01", 0.1, 3, False), ("p3", "zzz", "", "2024-01-01", 0.1, 3, False)]
    df = spark.createDataFrame(rows, "paper_id string, title string, abstract string, published_date string, similarity double, citation_count int, is_new boolean").withColumn("g", F.lit("g"))
    out = ranking.ranked_groups(df, today="2026-01-15", positive=["liked", *[f"other{k}" for k in range(5)]], negative=[], active=True, groups=["g"]).collect()
    assert {r["paper_id"]: r["reasons"] for r in out}["p1"] == "New this month; Strong match to your interests"
    assert [r["paper_id"] for r in sorted(out, key=lambda r: r["position"])] == ["p1", "p3", "p2"]


def test_whole_queries_are_searched(spark, tmp_path):
    """words after the twentieth of a query count as all others do."""
    rows = [(k, " ".join(f"w{x}" for x in range(k, k + 5))) for k in range(60)]
    index = postings.LexicalIndex(spark, str(tmp_path), postings.Layout(("text",), (), buckets=4, window_docs=16))
    index.add(spark.createDataFrame(rows, "id long, text string"))
    asked = [(1, " ".join(["nothing"] * 20 + ["w50", "w51", "w50"])), (2, " ".join(f"w{x}" for x in range(30)))]
    got = index.search_many(spark.createDataFrame(asked, "q long, words string"), "q", "words", field="text", top=60).collect()
    assert {r["id"] for r in got if r["query_id"] == 1} == set(range(46, 52)) and {r["id"] for r in got if r["query_id"] == 2} == set(range(30))
    assert len({r["score"] for r in got if r["query_id"] == 1 and r["id"] in (46, 47)}) == 2


def _near_copies(rng, sizes, copies, vocabulary=6000):
    """Sets of which some are close to 0.8, on both sides."""
    vocabulary, out = [f"w{k}" for k in range(vocabulary)], []
    for n in sizes:
        base = rng.choice(vocabulary, n, replace=False).tolist()
        for _ in range(copies):
            cut = int(rng.integers(0, max(2, n // 7)))
            out.append(sorted({*base[cut:], *rng.choice(vocabulary, int(rng.integers(0, max(2, n // 9)))).tolist()}))
    return out


def test_sets_travel_to_blocks_not_pairs(spark, monkeypatch):
    """a set goes to the few blocks that it is compared with, not once a pair; all pairs come out, large sets meet several times."""
    rng = np.random.default_rng(5)
    sets = _near_copies(rng, (1, 3, 8, 30, 120, 700, 1500), 30)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "id long, t array<string>")
    dealt = []
    monkeypatch.setattr(cluster, "BLOCK", 16)
    blocks = cluster.blocks

    def counted(pairs, sets):
        dealt.append((pairs.count(), (out := blocks(pairs, sets)).count()))
        return out

    monkeypatch.setattr(cluster, "blocks", counted)
    got = {(r["a"], r["b"]): r["jaccard"] for r in cluster.jaccard_links(df, "id", F.col("t"), 0.8).collect()}
    least, want = {}, {}
    for i, t in enumerate(sets):
        if t:  # sets without a token have no links
            least.setdefault(tuple(t), i)
    want |= {(least[tuple(t)], i): 1.0 for i, t in enumerate(sets) if t and least[tuple(t)] != i}
    own = {i: set(t) for t, i in least.items()}
    for a in own:
        for b in own:
            if a < b and (j := float(np.floor(len(own[a] & own[b]) / len(own[a] | own[b]) * 1e6 + 0.5)) / 1e6) >= 0.8:
                want[a, b] = j
    assert got == want and len(want) > 1000
    ((pairs, rows),) = dealt
    assert pairs > 1000 and rows < pairs / 2


def test_pairs_meet_once_or_often_enough():
    """small near copies are met about once a pair, not at each shared token; large sets that share few of their first tokens are no candidates, and no pair is lost."""
    rng = np.random.default_rng(8)
    small, large = _near_copies(rng, (60, 200), 25), _near_copies(rng, (900,) * 12, 2, 200_000)
    for sets, most in ((small, 4), (large, 1000)):
        names = {t: k for k, t in enumerate(sorted({x for s in sets for x in s}))}
        hashes = rng.integers(-(2**62), 2**62, len(names))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([sorted(hashes[names[x]] for x in s) for s in sets], pa.list_(pa.int64()))], ["id", "h"])
        none = np.zeros(0, np.int64)
        first = pa.Table.from_batches(list(cluster._first_tokens(iter([batch]), (none, none), 0.8 - 1e-6))).sort_by([("token", "ascending"), ("n", "ascending")])
        met, asked = {}, {}
        for b in cluster._met(iter(first.combine_chunks().to_batches()), 0.8 - 1e-6):
            for x, y, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (min(x, y), max(x, y))
                met[key], asked[key] = met.get(key, 0) + 1, n
        own = [set(s) for s in sets]
        want = {(i, j) for j in range(len(own)) for i in range(j) if len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8}
        found = {k for k, n in met.items() if n >= asked[k]}
        assert want <= found and len(want) >= 6 and sum(met.values()) < most * len(met)
    assert set(asked.values()) <= {3, 4, 5} and len(found) < len(want) + 20 and len(met) > 2 * len(found)


def test_large_texts_are_told_apart_by_fine_signs(spark, monkeypatch):
    """signs of 1024 bits let all pairs of large texts through, whose sets then travelled; finer ones rule them out, and no near copy is lost."""
    from fathomline.llm import simhash

    rng = np.random.default_rng(2)
    one, two = (np.unique(rng.integers(-(2**62), 2**62, n)) for n in (3000, 5000))
    assert len(simhash._fine_sign(one[:1024])) == 0 and len(simhash._fine_sign(one)) == 4096 // 8 and len(simhash._fine_sign(two)) == 8192 // 8
    for x, y in ((one, two), (one, one[:2600]), (two, np.union1d(two[300:], one[:50]))):
        assert 0 < simhash._apart(simhash._fine_sign(x), simhash._fine_sign(y)) <= len(np.setxor1d(x, y))
    coarse = lambda x: np.frombuffer(simhash._sign(x), np.uint8)
    assert np.bitwise_count(coarse(one) ^ coarse(two)).sum() < 8000 / 9 < simhash._apart(simhash._fine_sign(one), simhash._fine_sign(two))
    words = [f"w{k}" for k in range(400)]
    shared, texts = " ".join(rng.choice(words, 900)), []
    for k in range(12):  # a third of each text is common to all; every third has a near copy and one that is not near enough
        own = [shared, *rng.choice(words, 1900).tolist()]
        texts.append(" ".join(own))
        if k % 3 == 0:
            texts += [" ".join([*own[:-150], "end"]), " ".join([*own[:-700], "end"])]
    asked, blocks = [], simhash.blocks
    monkeypatch.setattr(simhash, "blocks", lambda pairs, sets, most: asked.append((pairs.count(), sets.count())) or blocks(pairs, sets, most))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["keep_id"] for r in simhash.similar_documents(df).collect()}
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    want = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want = [want[i] if x == want[j] else x for x in want]
    assert got == dict(enumerate(want)) and len(set(want)) == 16
    assert max(n for n, _ in asked) <= 8 and max(n for _, n in asked) <= 12
