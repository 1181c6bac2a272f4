"""Byte-level BPE by monoid tree reduction.

A text is halved until a part has at most ``leaf`` characters; leaves are encoded by the rank table. Two neighbours are joined by encoding anew a
window around their border, which grows until it ends, on both sides, at a place that surely starts a match of the pattern whatever
stands around it: a single space between two characters that aren't white space. A match that holds a character other than white space
holds a space only as its first character, so none runs over such a place, and what stands on one side of it can't change the matches on the
other. The tokens outside the window are therefore those of the whole text. A window without such a place grows to the whole part.
Decoding turns leaves of the token list into bytes and concatenates up the tree.

Defined cases: null text counts as empty (no ids); identifiers may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.tokens import little_endian, rank_encoding


def _sure_start(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace() and text[at - 1] not in _SEPARATORS and text[at + 1] not in _SEPARATORS


#: Counted as white space by one of the two Unicode tables only.
_SEPARATORS = "\x1c\x1d\x1e\x1f\x85᠎​‎‏  "


class TreeCodec:
    def __init__(self, path: str, pattern: str, leaf: int = 4096, window: int = 32) -> None:
        self.path, self.pattern, self.leaf, self.window = path, pattern, leaf, window

    def encode(self, text: str) -> list[int]:
        return self._encode(rank_encoding(self.path, self.pattern), text, 0, len(text))

    def _encode(self, enc, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return enc.encode_ordinary(text[a:b])
        middle = (a + b) // 2
        return self._join(enc, text, a, middle, b, self._encode(enc, text, a, middle), self._encode(enc, text, middle, b))

    def _join(self, enc, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        low, high = self._settled(text, a, m, b)
        keep = self._count(enc, left, len(text[low:m].encode()), from_end=True)
        skip = self._count(enc, right, len(text[m:high].encode()), from_end=False)
        return left[: len(left) - keep] + enc.encode_ordinary(text[low:high]) + right[skip:]

    def _settled(self, text: str, a: int, m: int, b: int) -> tuple[int, int]:
        # the character after a sure start must lie in the same half, else that half's own tokens may not break there
        size, low, high = self.window, None, None
        while low is None or high is None:
            left_end, right_end = max(a, m - size), min(b, m + size)
            if low is None:
                low = next((i for i in range(m - 2, left_end, -1) if _sure_start(text, i)), a if left_end == a else None)
            if high is None:
                high = next((i for i in range(m + 1, right_end - 1) if _sure_start(text, i)), b if right_end == b else None)
            size *= 2
        return low, high

    @staticmethod
    def _count(enc, ids: list[int], size: int, *, from_end: bool) -> int:
        """How many ids at the end (or start) of ``ids`` make ``size`` bytes."""
        n = 0
        while size > 0:
            size -= len(enc.decode_single_token_bytes(ids[-1 - n] if from_end else ids[n]))
            n += 1
        assert size == 0, "the window must end between tokens"
        return n

    def decode(self, ids: list[int]) -> bytes:
        enc = rank_encoding(self.path, self.pattern)
        if len(ids) <= self.leaf:
            return enc.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_documents(docs: DataFrame, codec: TreeCodec, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, ids array<int>."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([codec.encode(t or "") for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, codec: TreeCodec, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: digests of the ids and of what they decode to, without carrying either through the JVM."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                ids = codec.encode(t or "")
                out.append((len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
