"""What the findings of round 3 were about."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fathomline.operators import cluster, parse, postings, ranking


def test_nearby_meets_pages_not_figures(spark):
    """figures of one page share the search of its passages; given twice, null or far away they come out as in the SQL."""
    figures = [(v, p, f"l{k}") for v in (1, 2, None) for p in (3, 4, None) for k in range(4)] + [(1, 3, "l0")] * 2 + [(1, 3, None), (9, 3, "x")]
    passages = [(1 + k % 2, f"e{k:03}", k % 5, k % 5 + k % 3, f"text {k}") for k in range(60)] + [(2, "all", -(2**31), 2**31 - 1, None), (2, "none", 5, 4, "t")]
    f = spark.createDataFrame(figures, "version int, page int, label string")
    p = spark.createDataFrame(passages, "version int, evidence_id string, page_start int, page_end int, text string")
    found = parse.nearby(f, p)
    got = [(r["version"], r["page"], r["label"], ",".join(r["nearby_evidence_ids"]) if r["nearby_evidence_ids"] else None) for r in found.collect()]
    c = duckdb.connect()
    c.execute("CREATE TABLE f (version INT, page INT, label VARCHAR)"), c.execute("CREATE TABLE p (version INT, ev VARCHAR, ps INT, pe INT, text VARCHAR)")
    c.executemany("INSERT INTO f VALUES (?, ?, ?)", figures), c.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?)", passages)
    want = c.execute(
        """WITH j AS (SELECT f.*, ev, row_number() OVER (PARTITION BY f.version, page, label ORDER BY ev) AS n FROM f JOIN p ON p.version = f.version AND ps <= page AND pe >= page),
        a AS (SELECT version, page, label, string_agg(ev, ',' ORDER BY ev) AS nearby FROM j WHERE n <= 8 GROUP BY ALL) SELECT f.*, nearby FROM f LEFT JOIN a USING (version, page, label)"""
    ).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # the pages' range is looked at beside a page's list, in no join of figures with passages
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "page_start" in line]


def test_leading_is_one_pass_over_groups(spark):
    """the groups are those of comparing sets one by one, and tokens are compared with all groups at once."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        topic = int(rng.integers(0, 12))
        tokens = {f"t{topic}-{int(x)}" for x in rng.integers(0, 12, int(rng.integers(0, 9)))}
        vector = None if i % 3 == 0 else np.eye(12)[topic] + rng.normal(0, 0.4, 12)
        rows.append((f"p{i:03}", tokens, None if vector is None else vector / np.linalg.norm(vector)))

    def alike(group, tokens, vector):
        union = len(tokens | group["tokens"])
        lexical = len(tokens & group["tokens"]) / union if union else 0.0
        return lexical if vector is None or group["centre"] is None else 0.78 * max(0.0, min(1.0, float(vector @ group["centre"]))) + 0.22 * lexical

    def join(group, paper, tokens, vector, score):
        n = len(group["members"])
        group["members"].append((paper, score))
        group["tokens"] |= tokens
        if vector is not None:
            mean = vector if group["centre"] is None else (group["centre"] * n + vector) / (n + 1)
            group["centre"] = mean if group["centre"] is None else mean / np.sqrt(mean @ mean)

    for most in (5, 48):
        groups, known = [], {}
        for paper, tokens, vector in rows:
            known[paper] = (tokens, vector)
            scores = [alike(g, tokens, vector) for g in groups]
            best = int(np.argmax(scores)) if scores else -1
            if best < 0 or (scores[best] < 0.58 and len(groups) < most):
                groups.append({"members": [], "tokens": set(), "centre": None})
                join(groups[-1], paper, tokens, vector, 1.0)
            else:
                join(groups[best], paper, tokens, vector, scores[best])
        large, left = [g for g in groups if len(g["members"]) > 1], []
        for g in [g for g in groups if len(g["members"]) == 1]:
            paper = g["members"][0][0]
            scores = [alike(x, *known[paper]) for x in large]
            if max(scores) >= 0.42:
                join(large[int(np.argmax(scores))], paper, *known[paper], max(scores))
            else:
                left.append(g)
        want = [g["members"] for g in large + left]
        got = [g.members for g in cluster.lead(rows, 0.58, most)]
        assert [[p for p, _ in g] for g in got] == [[p for p, _ in g] for g in want] and [s for g in got for _, s in g] == pytest.approx([s for g in want for _, s in g])
    # 4000 papers of 300 tokens beside 48 groups
    began = time.perf_counter()
    words = [f"w{k}" for k in range(5000)]
    many = [(f"p{i}", {words[x] for x in rng.integers(0, 5000, 300)}, None) for i in range(4000)]
    assert sum(len(g.members) for g in cluster.lead(many, 0.58, 48)) == 4000 and time.perf_counter() - began < 8


def test_blocks_are_made_window_by_window(monkeypatch):
    """F6 to F10: the blocks are those of counting words one by one; a window of very many words has several blocks of a term."""
    rng = np.random.default_rng(5)
    docs = [(w, [None if rng.random() < 0.1 else [f"w{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 12)))] for _ in range(2)]) for w in (0, 2, 3) for _ in range(30)]
    want, seen = {}, {}
    for w, texts in docs:
        d = seen[w] = seen.get(w, -1) + 1
        for k, words in enumerate(texts):
            for i, t in enumerate(words or []):
                want.setdefault((w, t), {}).setdefault(d, []).append(k * postings.FIELD + i)
    length = {(w, d): sum(len(t or []) for t in x[1]) for w in (0, 2, 3) for d, x in enumerate([x for x in docs if x[0] == w])}

    def batches(size):
        for at in range(0, len(docs), size):
            part = docs[at : at + size]
            yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in part], pa.int32()), **{f"t{k}": pa.array([x[k] for _, x in part], pa.list_(pa.string())) for k in range(2)}})

    for most, size in ((1 << 22, 1000), (1 << 22, 7), (40, 7), (1, 100)):
        monkeypatch.setattr(postings, "MOST_WORDS", most)
        rows = [r for b in postings._inverted(batches(size), fields=2) for r in b.to_pylist()]
        got = {}
        for r in rows:
            assert r["n"] == len(r["doc"]) and r["short"] == min(r["len"]) and r["top"] == [max(x) for x in zip(*r["tf"], strict=True)] and r["doc"] == sorted(r["doc"])
            for d, n, tf, pos in zip(r["doc"], r["len"], r["tf"], r["pos"], strict=True):
                assert n == length[r["window"], d] and tf == [sum(p // postings.FIELD == k for p in pos) for k in range(2)]
                assert d not in got.setdefault((r["window"], r["term"]), {})
                got[r["window"], r["term"]][d] = pos
        assert got == want and (len(rows) == len(want)) == (most > 40)


def test_first_tokens_lose_no_pair():
    """F1: of all pairs at 0.8 or more none is ruled out where first tokens meet, however the rows are cut into batches."""
    rng = np.random.default_rng(7)
    base = [set(rng.integers(-(2**62), 2**62, n).tolist()) for n in (1, 4, 5, 9, 15, 40, 200, 900)]
    sets = []
    for b in base:
        for _ in range(8):
            words = list(b)
            kept = words[: len(words) - int(rng.integers(0, max(1, len(words) // 7)))]
            sets.append(set(kept) | set(rng.integers(-(2**62), 2**62, int(rng.integers(0, max(1, len(words) // 9)))).tolist()))
    frequent = np.array(sorted(base[4]), np.int64), np.arange(len(base[4]), dtype=np.int64) + 2
    ids = pa.array([f"d{i:02}" for i in range(len(sets))])
    batch = pa.RecordBatch.from_arrays([ids, pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["id", "h"])
    first = pa.Table.from_batches(list(cluster._first_tokens(iter([batch]), frequent, 0.8 - 1e-6))).sort_by([("token", "ascending"), ("n", "ascending")])
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    for size in (3, 1000):
        got = set()
        for met in cluster._met(iter(first.combine_chunks().to_batches(max_chunksize=size)), 0.8 - 1e-6):
            got |= {(max(x, y), min(x, y)) for x, y in zip(*([int(v[1:]) for v in met.column(c).to_pylist()] for c in (0, 1)), strict=True)}
        assert want <= got and len(want) > 20 and len(got) < len(want) + 60


def test_halves_are_rounded_as_in_the_sql(spark):
    """percentiles of a cohort of 321 have seven places; what is a half in decimal form is not one as a double."""
    rows = [(f"p{i:03}", "t", "a", "2024-01-01", 0.5, i, False, "g") for i in range(321)]
    df = spark.createDataFrame(rows, "paper_id string, title string, abstract string, published_date string, similarity double, citation_count int, is_new boolean, g string").coalesce(1)
    got = {r["paper_id"]: r["citation"] for r in ranking.ranked_groups(df, today="2026-01-15", positive=[], negative=[], active=False, groups=["g"]).collect()}
    want = dict(duckdb.sql("SELECT 'p' || lpad(CAST(i AS VARCHAR), 3, '0'), round(i / 320.0::DOUBLE, 6) FROM range(321) r(i)").fetchall())
    assert got == want
