"""SentencePiece operator against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from fathomline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["▁", " ", "  ", "   ", "\t", "\n", "\r", "a", "b", "the", "ing", "ther", "io", "ions", "to", "ng", "n", "g", "i", "é", "漢", "字", "\x00", "ﬀ", "😀", "‍", "0", "12", "<s>", "</s>", "<0x41>", "aa", "ab", "ß", "ж", "или", "�", "'", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts, **how):
    own = pieces.model(PATH)
    for text, ids in zip(texts, own.encode(texts, **how), strict=True):
        expected = library.encode(text, add_eos=True)
        assert ids.tolist() == expected, text[:200]
        assert own.decode(ids).decode() == library.decode(expected)


def test_random_texts(library):
    rng = random.Random(3)
    same(library, ["".join(rng.choice(PARTS) for _ in range(rng.randrange(n))) for n in (2, 3, 5, 9, 20, 60, 300) for _ in range(400)])


@pytest.mark.parametrize("text", [" " * 100_000, "x" + " " * 15 + "y" + " " * 47, " ▁" * 999, "a" * 50_000, "the" * 20_000, "ther" * 9_000, "ing" * 3333 + "ng" * 3333, "\x00" * 5000, "漢" * 3000, "𒀀" * 3000])
def test_long_and_repeating_texts(library, text):
    same(library, [text])
    same(library, [text], chunk=1000)


def test_cuts_change_nothing(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("thering  ▁é") for _ in range(30_000)), "", "word " * 5000]
    same(library, texts, chunk=500)


def test_decoding_of_any_ids(library):
    rng = random.Random(9)
    own = pieces.model(PATH)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32_000), 233, 152, 234, 243, 162, 155, 131]) for _ in range(rng.randrange(12))]
        assert own.decode(ids).decode() == library.decode(ids), ids


def test_tables(spark, docs, odd, empty, library):
    for df in (docs, odd):
        expected = []
        for row in df.select("doc_id", "text").collect():
            ids = library.encode(row["text"] or "", add_eos=True)
            expected.append((row["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, pieces.round_trip(df, PATH).collect()), key=str) == sorted(expected, key=str)
    encoded = pieces.encode_documents(docs, PATH)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {r["doc_id"]: library.encode(r["text"] or "", add_eos=True) for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, PATH).collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert pieces.round_trip(empty, PATH).count() == 0 and pieces.encode_documents(empty, PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        pieces.PieceModel(str(tmp_path / "m.model"))
