import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import exact_dedup, fm_index, simhash, suffix_dedup, windows


def sha(b):
    return hashlib.sha256(b).hexdigest()


# exact


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        known = [x for x in groups[n] if x is not None]
        out.append((i, min(known) if known else None, len(groups[n]), sha(n.encode())))
    return Counter(out)


@pytest.mark.parametrize("memory", [256 << 20, 12_000])
def test_exact_groups(docs, rows, memory):
    got = exact_dedup.exact_groups(docs, memory_bytes=memory).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_exact_odd_identifiers(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact_dedup.exact_groups(odd).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    stays = exact_dedup.keep_first_copies(odd)
    assert stays.columns == odd.columns
    assert stays.count() == len(kept)


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_first_copies(empty).count() == 0


def test_trie_matches_dict():
    rng = random.Random(1)
    trie, plain = exact_dedup.PatriciaTrie(), {}
    for _ in range(3000):
        key = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(0, 12)))
        node = trie.terminal(key)
        node.entry = (node.entry or 0) + 1
        plain[key] = plain.get(key, 0) + 1
    assert dict(trie.entries()) == plain
    gone = dict(trie.spill_largest())
    assert gone and not gone.keys() & dict(trie.entries()).keys()
    assert {**dict(trie.entries()), **gone} == plain
    assert all(trie.terminal(k) is None for k in gone)


def test_trie_spills_below_a_shared_prefix():
    rng = random.Random(1)
    trie, plain = exact_dedup.PatriciaTrie(), {}
    for k in range(500):
        key = b'{"a long beginning that all share": "' + str(rng.random()).encode()
        trie.terminal(key).entry = k
        plain[key] = k
    gone = {}
    while (cut := trie.spill_largest()) is not None:
        gone.update(cut)
    left = dict(trie.entries())
    assert len(left) >= 1 and {**gone, **left} == plain
    assert trie.bytes < 3000


def test_exact_spills_in_rounds(spark, monkeypatch):
    """Texts that all begin alike, and one with many copies, at a budget that only a part of them fits."""
    rows = [(i, f"{{{i % 400} some text that is long enough to count}}") for i in range(700)] + [(1000 + i, "{") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    staged = []
    stage = exact_dedup.stage
    monkeypatch.setattr(exact_dedup, "stage", lambda df, label, *a: staged.append(label) or stage(df, label, *a))
    got = exact_dedup.exact_groups(docs, memory_bytes=20_000).collect()
    assert staged.count("exact-owned") > 2
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    assert sum(r["kept"] for r in got) == 401


def test_exact_first_copy_is_settled(spark):
    rows = [(1, "a  b", "y"), (1, "a b", "z"), (1, "a b", "x"), (None, "a b", "w")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for n in (1, 3):
        assert [tuple(r) for r in exact_dedup.keep_first_copies(docs.repartition(n)).collect()] == [(1, "a  b", "y")]


def test_exact_query_is_its_sql(spark, tmp_path):
    """Repeated identifiers too: one row of a group stays."""
    import duckdb

    from fathomline.llm import queries

    rows = [(1, "a  b"), (1, "a b"), (1, "a b"), (2, "a\tb"), (3, None), (3, ""), (None, "x"), (None, "x"), (None, "a b"), (5, "y" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_exact(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_exact"])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


# words


def brute_words(rows):
    windows_of = Counter()
    for _, t in rows:
        ws = (t or "").encode().split()
        for i in range(len(ws) - 34):
            windows_of[tuple(ws[i : i + 35])] += 1
    out = []
    for d, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for i in range(len(ws) - 34):
            if windows_of[tuple(ws[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((d, len(ws), sum(gone), sha(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g))))
    return Counter(out)


def test_words(docs, rows):
    got = fm_index.remove_repeated(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_words(rows)
    assert all(sha(r["kept"].encode()) == r["kept_sha256"] for r in got)


def test_words_odd_and_empty(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = fm_index.remove_repeated(odd, want_text=False).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_words(rows)
    assert fm_index.remove_repeated(empty).count() == 0


@pytest.mark.parametrize("alphabet", [2, 5, 200])
def test_index_counts(alphabet):
    rng = np.random.default_rng(alphabet)
    text = rng.integers(1, alphabet + 1, 700)
    text[[99, 300, 301, 699]] = 0
    index = fm_index.FMIndex(text, np.where(text > 0, 1, 0), alphabet + 1, 12)
    for size in (1, 2, 5, 11):
        for start in rng.integers(0, 680, 40):
            pattern = text[start : start + size]
            if (pattern == 0).any():
                continue
            low, high = np.array([0]), np.array([len(text)])
            for s in pattern[::-1]:
                low, high = index.step(np.array([s]), low, high)
            want = sum((text[i : i + size] == pattern).all() for i in range(len(text) - size + 1))
            assert high[0] - low[0] == want


@pytest.mark.parametrize("alphabet", [2, 3, 40])
def test_window_search(alphabet):
    rng = np.random.default_rng(alphabet)
    size = rng.integers(8, 60, 30)
    base = np.cumsum(size + 1) - size - 1
    text = rng.integers(1, alphabet + 1, int((size + 1).sum()))
    text[base + size] = 0
    if alphabet == 40:
        text[base[3] : base[3] + 8] = text[base[7] : base[7] + 8]
    weight = np.repeat(rng.integers(1, 3, 30), size + 1)
    weight[base + size] = 0
    index = fm_index.FMIndex(text, weight, alphabet + 1, 8)
    got = fm_index.repeated_windows(index, text, base, size, 8, lanes=7)
    count = Counter()
    for b, n in zip(base, size, strict=True):
        for i in range(b, b + n - 7):
            count[tuple(text[i : i + 8])] += int(weight[i])
    for b, n in zip(base, size, strict=True):
        for i in range(b, b + n - 7):
            assert got[i] == (count[tuple(text[i : i + 8])] >= 2)


# bytes


def brute_bytes(rows):
    """Null identifiers come last; rows that share an identifier have the same rank."""
    rank = [1 << 63 if d is None else d for d, _ in rows]
    least = {}
    for k, (_, t) in zip(rank, rows, strict=True):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(k, least.get(b[p : p + 50], k))
    out = []
    for k, (d, t) in zip(rank, rows, strict=True):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


def test_bytes(docs, rows):
    got = suffix_dedup.remove_repeated(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_bytes(sorted(rows))


def test_bytes_odd_and_empty(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = suffix_dedup.remove_repeated(odd, want_text=False).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_bytes(rows)
    assert suffix_dedup.remove_repeated(empty).count() == 0


def test_bytes_of_one_identifier_stay(spark):
    shared = "".join(random.Random(1).choices("abcdefgh ", k=80))
    rows = [(1, f"x {shared} y"), (1, f"z {shared} w"), (2, f"v {shared} u"), (None, shared), (None, shared)]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), want_text=False).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("1", 0), ("2", 82), ("None", 80), ("None", 80)]


def test_very_long_documents(spark):
    """Over a million symbols, so that documents are cut into blocks: words for the index, bytes for the ranking, letters for the trie, shingles for the fingerprint."""
    rng = random.Random(12)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    long = [f"{rng.randrange(36**3):x}" for _ in range(1_100_000)]
    for at in (5, windows.BLOCK - 30, 2 * windows.BLOCK - 10, 1_050_000):
        long[at : at + 60] = passage
    rows = [(2, " ".join(long)), (1, " ".join([*long[:300], *passage])), (3, " ".join(long[1000:1030]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fm_index.remove_repeated(docs, want_text=False).collect()}
    want = {r[0]: r for r in brute_words(rows)}
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == {k: tuple(r[1:]) for k, r in want.items()}
    assert got[2]["n_removed"] >= 240
    whole = rows
    rows = [(2, rows[0][1][: 2 * windows.BLOCK + 9000] + " " + " ".join(passage)), *rows[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs, want_text=False).collect()}
    assert got[2]["n_removed"] > 1000
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.values()} == set(brute_bytes(rows))
    assert len(whole[0][1].split()) > 2 * windows.BLOCK
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {r["id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(docs).collect()} == prints
    twice = docs.unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(9)).withColumn("text", F.concat("text", F.lit(" end"))))
    assert {r["doc_id"] for r in simhash.keep_one_of_each(twice).collect()} == {1, 2, 3}
    twice = docs.unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(9)))
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(twice).collect()} == {(1, 1, 1), (2, 2, 2), (3, 3, 1), (9, 2, 2)}


def test_segments_meet():
    """Every window is in one segment, and equal windows have equal keys."""
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 3, n) for n in (400, 9, 10, 0, 300)]
    symbols = windows.mixed(np.concatenate(parts).astype(np.uint64) + np.uint64(1))
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    found = windows.segments(symbols, bounds, 10, 4)
    seen, keys = Counter(), {}
    for key, own, start, wins in zip(found["key"].tolist(), found["owner"].tolist(), found["start"].tolist(), found["wins"].tolist(), strict=True):
        for i in range(start, start + wins):
            seen[own, i] += 1
            assert keys.setdefault(tuple(parts[own][i : i + 10]), key) == key
    assert seen == Counter((o, i) for o, p in enumerate(parts) for i in range(len(p) - 9))


def test_document_bucket(spark):
    rows = np.array([0, 1, -5, 10**12, 77], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(x),) for x in rows], "row long").select(F.pmod(F.xxhash64("row"), F.lit(13))).collect()]
    assert windows.document_bucket(rows, 13).tolist() == want


# SimHash


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    import xxhash

    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(docs, rows, bucket):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = brute_components(prints)
    got = simhash.near_duplicates(docs, bucket_rows=bucket).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert {r["id"]: r["hex"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}


def test_close_links_exhaustive(spark):
    """Chains and balls of close fingerprints, with buckets so small that they are cut again and again."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10]:
        x = b
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    want = brute_components({f: f for f in fps})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bucket in (1, 3, 4096):
        members = {r[0] % (1 << 64): r[1] % (1 << 64) for r in simhash.connected_components(simhash.close_links(df, bucket_rows=bucket)).collect()}
        parts, wanted = defaultdict(set), defaultdict(set)
        for f in fps:
            parts[members.get(f, f)].add(f)
            wanted[want[f]].add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_odd_and_empty(odd, empty):
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_of_each(empty).count() == 0


def test_wide_near_copies(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(40):
        ws = [f"v{rng.randrange(5000)}" for _ in range(400)]
        rows.append((k * 10, " ".join(ws)))
        for j in range(1, 4):
            copy = list(ws)
            for at in rng.sample(range(400), j * 2):
                copy[at] = "changed"
            rows.append((k * 10 + j, " ".join(copy)))
        want.add(k * 10)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component string")
    kept = simhash.keep_one_of_each(docs, jaccard=0.77)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want


def near_corpus():
    """Families with pairs round a similarity of 0.8: short texts, long ones, lines that repeat, and many copies of one text."""
    rng = random.Random(5)
    texts = []
    for n in [10, 11, 40, 60, 120, 400] * 12:
        base = [f"u{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(base))
        for cut in (0.09, 0.1, 0.105, 0.11, 0.115, 0.12, 0.2):
            new = max(1, round(n * cut))
            texts.append(" ".join([*base[:-new], *(f"u{rng.randrange(10**6)}" for _ in range(new))]))
    line = " ".join(f"l{k}" for k in range(12))
    texts += [f"{line} " * 30 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(k % 5)) for k in range(80)]
    base = [f"b{k}" for k in range(200)]
    texts += [" ".join([*base[k % 28 :], *(f"u{rng.randrange(10**6)}" for _ in range(k % 28))]) for k in range(120)]
    return list(enumerate(texts))


def brute_near_components(rows, jaccard):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    held, counts = {}, {}
    for i, s in sets.items():
        for x in s:
            for j in held.setdefault(x, []):
                counts[j, i] = counts.get((j, i), 0) + 1
            held[x].append(i)
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    near = 0
    for (i, j), c in counts.items():
        similarity = c / (len(sets[i]) + len(sets[j]) - c)
        near += jaccard <= similarity < jaccard + 0.05
        if similarity >= jaccard:
            a, b = sorted((root(i), root(j)))
            name[b] = a
    return {i: root(i) for i in sets}, near


def test_near_copies_equal_brute_force(spark):
    rows = near_corpus()
    want, near = brute_near_components(rows, 0.8)
    assert near > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()} == set(want.values())


def test_near_copies_by_row(spark):
    """A text stays that has no near copy, whatever its identifier; near copies that share an identifier go but for one; a null identifier comes last."""
    rng = random.Random(3)
    base = [[f"u{rng.randrange(10**6)}" for _ in range(100)] for _ in range(5)]
    near = lambda k, j: " ".join([*base[k][:-1], f"changed{j}"])
    rows = [(1, near(0, 0)), (2, near(0, 1)), (2, near(1, 0)), (3, near(2, 0)), (3, near(2, 1)), (None, near(3, 0)), (None, near(3, 1)), (7, near(3, 2)), (8, None), (9, ""), (4, near(4, 0)), (4, near(4, 0))]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, keep_id string, h int")
    kept = simhash.keep_one_of_each(docs.repartition(3))
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "7", "8"]
    assert next(r["text"] for r in got if r["doc_id"] == 2) == near(1, 0)


def test_near_candidates_come_from_fingerprints(spark):
    """The pigeonhole join alone finds copies that differ in a word of a long text."""
    rng = random.Random(3)
    base = [f"u{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(base), " ".join([*base[:450], "new", *base[451:]]), " ".join(f"u{rng.randrange(10**6)}" for _ in range(900))]
    prints = [simhash.voted(simhash.shingle_hashes(t, 5)) for t in texts]
    own = spark.createDataFrame([(k, int(np.uint64(p).view(np.int64))) for k, p in enumerate(prints)], "node long, fp long")
    assert [tuple(r) for r in simhash._print_pairs(own).collect()] == [(0, 1)]
