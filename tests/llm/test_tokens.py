import random
import shutil
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fathomline.llm import bpe_tree, packing, training_order
from fathomline.llm.queries import document_ids
from fathomline.llm.tokens import PLAIN, little_endian, rank_encoding


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(reference, rows):
    encode = document_ids()
    plain = [chr(c) for c in range(0x250) if not PLAIN.search(chr(c))]
    texts = [t or "" for _, t in rows] + [f"ab{c}cd {c}{c} {c}x 1{c}2 '{c}s it's{c}" for c in map(chr, range(0x250))]
    rng = random.Random(2)
    texts += ["".join(rng.choice(plain) for _ in range(60)) for _ in range(400)] + ["don't  stop\n\n now <|endoftext|> we'll", "  ", "\n", "漢字 текст   x"]
    for text in texts:
        assert encode(text) == reference(text), repr(text)
    assert 50256 in encode("a <|endoftext|> b") and 50256 in encode("漢 <|endoftext|>")
    ordinary = document_ids(special=False)
    assert all(50256 not in ordinary(x) and 50256 not in ordinary(x + "漢") for x in ("a <|endoftext|> b", "<|endoftext|>"))


def test_very_long_texts(reference):
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "house", "isn't", "größer", "12345", "!!", "漢字"]) + str(rng.randrange(9)) for _ in range(200_000))
    assert len(text) > 1 << 20
    assert document_ids()(text) == reference(text)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe_tree.TreeCodec(path, P.PATTERN)
    ids = codec.encode(text)
    assert ids == rank_encoding(path, P.PATTERN).encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_tree_encodes_as_the_library(rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = rank_encoding(path, P.PATTERN)
    rng = random.Random(4)
    odd = "a é \x1c\x85  \t\n'sdlt.!?漢9 "
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 400))) for _ in range(300)] + ["b" * 5000, " " * 3000, "x y " * 900, "'s" * 700]
    for leaf, window in ((16, 1), (64, 8), (4096, 32)):
        codec = bpe_tree.TreeCodec(path, P.PATTERN, leaf, window)
        for text in texts:
            ids = codec.encode(text)
            assert ids == enc.encode_ordinary(text), (leaf, repr(text[:80]))
            assert codec.decode(ids) == text.encode()


def test_tree_tables(docs, odd, empty, rows):
    codec = bpe_tree.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = bpe_tree.round_trip(docs, codec).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert bpe_tree.encode_documents(odd, codec).count() == odd.count()
    assert bpe_tree.round_trip(empty, codec).count() == 0


def check_pieces(pieces, lengths, capacity):
    """Every token in one piece, sequences without gaps or overflow."""
    by_doc, by_sequence = {}, {}
    for k, start, n, sequence, offset in pieces:
        assert n > 0
        by_doc.setdefault(k, []).append((start, n))
        by_sequence.setdefault(sequence, []).append((offset, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc.get(k, [])):
            assert start == at
            at += size
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 64, 100, 63, 640, 650, 0, 333]) for _ in range(rng.randrange(0, 300))]
    n = check_pieces(packing.pack(lengths, 64), lengths, 64)
    assert n <= -(-sum(lengths) // 64)


def test_pack_balances_cost():
    lengths = [random.Random(9).randrange(1, 900) for _ in range(400)]
    cost = {}
    for _, _, n, s, _ in packing.pack(lengths, 1024):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert max(cost.values()) <= 2048


def test_pack_documents(docs, rows, odd, empty, reference):
    got = packing.pack_documents(docs, document_ids(), shard_tokens=3000).collect()
    text = dict(rows)
    ids = {i: np.array([*reference(t or ""), 0], "<u4") for i, t in text.items()}
    names = list(ids)
    check_pieces([(names.index(r["doc_id"]), r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], [len(ids[i]) for i in names], 1024)
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in packing.pack_documents(odd, document_ids()).collect()) == sum(len(reference(r["text"] or "")) + 1 for r in odd.collect())
    assert packing.pack_documents(empty, document_ids()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_feistel_is_a_permutation(n):
    order = training_order.Feistel(n, 99)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.sequence(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != training_order.Feistel(n, 100).slot(np.arange(n))).any()
        assert (np.diff(slots) == 1).mean() < 0.1


def plain_order(rows, encode, key, length, buckets):
    """slot -> ids, by an independent reading of the order: buckets, streams, and a permutation walked one number at a time."""
    import xxhash

    def hashed(*parts):
        """Spark's xxhash64 of longs and strings: each value's hash is the next one's seed."""
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    streams = {}
    for (i, h), t in sorted(((((1 << 63) - 1 if i is None else i), hashed(t or "")), t or "") for i, t in rows):
        bucket = hashed(i, h) % buckets
        streams.setdefault(bucket, []).extend([*encode(t), 50256])
    records = []
    for b in sorted(streams):
        records += [streams[b][a : a + length] for a in range(0, len(streams[b]), length)]
    n = len(records)
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    word, low = (1 << 64) - 1, (1 << half) - 1

    def mix(x, k):
        x = (x + (k & word)) * 0x9E3779B97F4A7C15 & word
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & word
        return x ^ (x >> 31)

    def once(x):
        left, right = x >> half, x & low
        for r in range(6):
            left, right = right, left ^ (mix(right, key * 1_000_003 + r) & low)
        return (right << half) | left

    out = {}
    for k, ids in enumerate(records):
        x = once(k)
        while x >= n:
            x = once(x)
        out[x] = ids
    return out


def test_materialise_and_resume(spark, rows, odd, empty, tmp_path):
    encode, target = document_ids(special=False), str(tmp_path / "shards")
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    settings = {"key": 5, "length": 64, "shard_records": 7, "bucket_bytes": 4000}
    layout = training_order.materialise(odd.repartition(2), encode, target, **settings)
    assert layout["buckets"] > 3
    want = plain_order(odd_rows, encode, 5, 64, layout["buckets"])
    n, stride = layout["sequences"], layout["stride"]
    assert n == len(want) and sorted(want) == list(range(n))

    def check():
        got = training_order.read_from(spark, target, layout).collect()
        assert {r["slot"]: r["ids"] for r in got} == want and len(got) == n
        assert sorted(r["sequence_id"] for r in got) == list(range(n))
        for r in got:
            assert r["shard_id"] == r["slot"] // 7 and r["byte_offset"] == r["slot"] % 7 * stride
            assert r["ids_crc32"] == zlib.crc32(little_endian(r["ids"]))

    check()
    # a record is found by arithmetic in the raw file
    folders = sorted(tmp_path.glob("shards/shard_id=*"), key=lambda p: int(p.name.split("=")[1]))
    assert len(folders) == -(-n // 7)
    for slot in (0, 6, 7, n - 1):
        (file,) = folders[slot // 7].glob("part-*")
        with open(file, "rb") as f:
            f.seek(slot % 7 * stride)
            data = f.read(stride)
        size = int.from_bytes(data[:4], "little")
        assert np.frombuffer(data, "<u2", size, 4).tolist() == want[slot]
    assert sorted(r["slot"] for r in training_order.read_from(spark, target, layout, first_slot=n - 10).collect()) == list(range(n - 10, n))
    # half the shards are lost: a run over another partitioning writes these and no others
    stay = {f: f.stat().st_mtime_ns for p in folders[1::2] for f in p.glob("part-*")}
    for p in folders[::2]:
        shutil.rmtree(p)
    assert training_order.materialise(odd.repartition(5), encode, target, **settings) == layout
    assert {f: f.stat().st_mtime_ns for f in stay} == stay
    check()
    # another key, another input or another length is another order
    for docs, change in ((odd, {"key": 6}), (odd, {"length": 32}), (odd, {"shard_records": 8}), (odd.limit(20), {})):
        with pytest.raises(ValueError, match="another"):
            training_order.materialise(docs, encode, target, **{**settings, **change})
    check()
    # a shard of the wrong size isn't taken for whole
    (file,) = folders[0].glob("part-*")
    file.write_bytes(file.read_bytes()[:-10])
    with pytest.raises(ValueError, match="wrong size"):
        training_order.materialise(odd, encode, target, **settings)
    none = training_order.materialise(empty, encode, str(tmp_path / "none"), key=5)
    assert none["sequences"] == 0 and training_order.read_from(spark, str(tmp_path / "none"), none).count() == 0


def test_a_broken_run_leaves_whole_shards(spark, odd, tmp_path, monkeypatch):
    encode, target = document_ids(special=False), str(tmp_path / "shards")
    settings = {"key": 5, "length": 64, "shard_records": 7, "bucket_bytes": 4000}
    restored, flag = training_order._restored, tmp_path / "break"
    flag.write_text("")

    def breaking(data, size):
        if size > 64 * 2 + 3 and flag.exists() and data[-1] % 16 == 3:
            raise OSError("an executor is gone")
        return restored(data, size)

    monkeypatch.setattr(training_order, "_restored", breaking)
    with pytest.raises(Exception, match="gone"):
        training_order.materialise(odd, encode, target, **settings)
    flag.unlink()
    layout = training_order.materialise(odd.repartition(3), encode, target, **settings)
    want = plain_order([(r["doc_id"], r["text"]) for r in odd.collect()], encode, 5, 64, layout["buckets"])
    assert {r["slot"]: r["ids"] for r in training_order.read_from(spark, target, layout).collect()} == want


def test_offsets_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(training_order, "CHUNK", 3)
    counts = {b: b * b % 7 + 1 for b in (0, 1, 2, 5, 6, 11, 12, 20)}
    got = {r["bucket"]: r["base"] for r in training_order.offsets(spark.createDataFrame(list(counts.items()), "bucket int, n long")).collect()}
    assert got == {b: sum(n for c, n in counts.items() if c < b) for b in counts}
