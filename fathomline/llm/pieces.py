"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The texts of a batch become one flat array of symbols, cut into words wherever two characters meet that no piece of the model holds side by side,
so that no merge can run over the cut. Equal words are worked out once. In each round the best rank of any pair is found in each word
(a segmented minimum), all its occurrences in the word are merged at once, leftmost first, and the arrays are compacted; words without
a pair that the model knows leave the arrays, and the rounds end when none is left.

The library takes one pair at a time: the best, and of equal ones the leftmost. A round gives the same result, since an occurrence is merged together with
the later ones of its word only where neither pair that it makes with a neighbour ranks as high as itself; in a word where one does, the round stops behind that occurrence.
Pieces that share the worst score and are runs of one character (white space) depend on the order at each step; once nothing else is left to merge,
such runs are replaced from a table that the same rounds fill for short runs, and that repeats with the longest piece; where a model's runs don't repeat so, the rounds go on.

Memory is bounded by ``chunk`` characters at a time; longer texts are cut between words. A text that is a single word is worked on whole.

Defined cases: null text counts as empty (the end id alone); identifiers may be null or repeat; other columns are ignored; an empty table gives an empty result.
Models that normalise text or drop white space are refused.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Symbols of characters without a piece of their own: this plus the code point.
OTHER = 1 << 20
_BITS = 22


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of segments of ``sizes``, one segment after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class PieceModel:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        own = spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or own.precompiled_charsmap or own.remove_extra_whitespaces or not own.escape_whitespaces or not own.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without normalisation, with a leading space, are supported")
        library = SentencePieceProcessor(model_file=path)
        kinds = [(library.id_to_piece(i), library.get_score(i)) for i in range(library.get_piece_size())]
        self.end = library.eos_id()
        byte = {int(p[3:5], 16): i for i, (p, _) in enumerate(kinds) if library.is_byte(i)}
        if len(byte) != 256 or any(library.is_unused(i) for i in range(len(kinds))) or any(x.type == x.USER_DEFINED for x in spec.pieces):
            raise ValueError("the model must fall back to bytes and hold no unused or user-defined piece")
        self.bytes = np.array([byte[b] for b in range(256)], np.int32)
        pieces = {p: i for i, (p, _) in enumerate(kinds) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
        scores = {p: kinds[i][1] for p, i in pieces.items()}

        self.symbol = np.arange(OTHER, OTHER + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self._pair_table(pieces, scores)
        self._adjacent(pieces)
        self._decoding(kinds, pieces, byte, library)
        self._runs(pieces, scores)

    def _pair_table(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        one = lambda p: pieces.get(p) if p in pieces else (OTHER + ord(p) if len(p) == 1 else None)
        rows = []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = one(p[:k]), one(p[k:])
                if a is not None and b is not None:
                    rows.append((a << _BITS | b, order[scores[p]], i))
        rows.sort()
        keys, self.ranks, self.made = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)
        # open addressing, at most an eighth full: most look-ups end at their first slot
        self.slots = 64 - max(10, (8 * len(keys)).bit_length())
        self.keys, self.row = np.full(1 << (64 - self.slots), -1, np.int64), np.zeros(1 << (64 - self.slots), np.int32)
        for k, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.row[slot] = key, k
        # pieces that stand in a pair which ranks as high as they do
        rank = np.full(max(pieces.values()) + 1, NONE, np.int32)
        rank[self.made] = self.ranks
        self.risky = np.zeros(len(rank), bool)
        for part in (keys >> _BITS, keys & ((1 << _BITS) - 1)):
            own = part < len(rank)
            worse = rank[part[own]] >= self.ranks[own]
            self.risky[part[own][worse]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.slots)).astype(np.int64)

    def _adjacent(self, pieces: dict[str, int]) -> None:
        """A table of the hashes of all pairs of characters that stand side by side in a piece."""
        pairs = np.array(sorted({(self.symbol[ord(a)], self.symbol[ord(b)]) for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.int64).reshape(-1, 2)
        self.beside = np.zeros(1 << 20, bool)
        self.beside[self._hash(pairs[:, 0], pairs[:, 1])] = True

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.astype(np.uint32) * np.uint32(0x85EBCA6B))) >> np.uint32(12)

    def _decoding(self, kinds: list, pieces: dict[str, int], byte: dict[int, int], library) -> None:
        out = [b""] * len(kinds)
        for p, i in pieces.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in byte.items():
            out[i] = bytes([b])
        for i in range(len(kinds)):
            if library.is_unknown(i):
                out[i] = " ⁇ ".encode()
        self.is_byte = np.zeros(len(kinds), bool)
        self.is_byte[self.bytes] = True
        self.control = np.array([library.is_control(i) for i in range(len(kinds))])
        self.leads = np.zeros(len(kinds), bool)
        for p, i in pieces.items():
            self.leads[i] = p.startswith(SPACE)
        self.surface = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.decimal = [str(i) for i in range(len(kinds))]

    def _runs(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        """Tables for runs of one character whose pieces share the worst score, if the model has such and they repeat."""
        self.run_rank, self.run_symbol = None, None
        many = [p for p in pieces if len(p) > 1]
        worst = min((scores[p] for p in many), default=None)
        own = [p for p in many if scores[p] == worst]
        if len(own) < 2 or len({c for p in own for c in p}) != 1 or any(set(p) == set(own[0]) and scores[p] != worst for p in many):
            return
        symbol, longest = int(self.symbol[ord(own[0][0])]), max(map(len, own))
        table = [np.array([], np.int32)]
        for n in range(1, 3 * longest + 1):
            table.append(self._merge(np.full(n, symbol, np.int32), np.zeros(n, np.int32))[0])
        block = table[longest]
        if len(block) == 1 and all(np.array_equal(table[n], np.concatenate((block, table[n - longest]))) for n in range(longest, len(table))):
            self.run_symbol, self.run_longest, self.run_block = symbol, longest, block[0]
            self.run_sizes, self.run_tokens = np.array([len(x) for x in table[:longest]]), np.concatenate(table[:longest])
            self.run_rank = self._pairs(np.array([symbol], np.int32), np.array([symbol], np.int32))[0][0]

    # encoding

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols, ``NONE`` where the model has no such piece."""
        key = left.astype(np.int64) << _BITS | right
        slot = self._slot(key)
        held = self.keys[slot]
        while len(far := np.flatnonzero((held != key) & (held >= 0))):
            slot[far] = (slot[far] + 1) % len(self.keys)
            held[far] = self.keys[slot[far]]
        at = self.row[slot]
        return np.where(held == key, self.ranks[at], NONE), self.made[at]

    def _settle_runs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace all runs of the run symbol by their pieces."""
        own = sym == self.run_symbol
        edge = np.concatenate(([True], (own[1:] != own[:-1]) | (word[1:] != word[:-1]) | ~own[1:]))
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(sym)))
        run = own[first]
        blocks, rest = np.where(run, size // self.run_longest, 0), np.where(run, size % self.run_longest, 0)
        tail = np.where(run, self.run_sizes[rest], 1)
        total = blocks + tail
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.int32)
        out[_flat(begin, blocks)] = self.run_block
        starts = np.cumsum(self.run_sizes) - self.run_sizes
        out[_flat((begin + blocks)[run], tail[run])] = self.run_tokens[_flat(starts[rest[run]], tail[run])]
        out[begin[~run]] = sym[first[~run]]
        return out, np.repeat(word[first], total)

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the words (ascending numbers) of a flat array of symbols: the symbols that are left, and their words."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pairs(sym, np.append(sym[1:], 0))
        rank[:-1][word[1:] != word[:-1]] = NONE
        rank[-1:] = NONE
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            if self.run_rank is not None and (ends := least == self.run_rank).any():
                gone = np.repeat(ends, sizes)
                done.append(self._settle_runs(sym[gone], word[gone]))
                least[ends] = NONE
                live = np.repeat(least < NONE, sizes)
                over = ~live & ~gone
            else:
                live = np.repeat(least < NONE, sizes)
                over = ~live
            if over.any():
                done.append((sym[over], word[over]))
            if not live.all():
                keep = least < NONE
                sym, word, rank, made, sizes, least = sym[live], word[live], rank[live], made[live], sizes[keep], least[keep]
                if not len(sym):
                    break
            best = np.repeat(least, sizes)
            at = np.flatnonzero(rank == best)
            # of occurrences that overlap, every other one from the left
            lead = np.concatenate(([True], np.diff(at) != 1))
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            at = at[self._undisturbed(sym, word, made, best, at)]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(touched)
            inner = near[near < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[near] = NONE
            rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        if not done:
            return sym, word
        sym, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _undisturbed(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        """True for the occurrences up to the first of their word that makes a pair with a neighbour which ranks as high as itself."""
        new = made[at]
        risky = self.risky[new]
        if not risky.any():
            return np.ones(len(at), bool)
        joined = np.concatenate(([False], at[1:] == at[:-1] + 2)) & np.concatenate(([False], word[at[1:]] == word[at[:-1]]))
        left = np.where(joined, np.concatenate(([0], new[:-1])), sym[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[after] == word[at])
        bad = np.zeros(len(at), bool)
        for own, a, b in ((risky & has_left, left, new), (risky & has_right, new, sym[after])):
            bad[own] |= self._pairs(a[own], b[own])[0] <= best[at[own]]
        if not bad.any():
            return np.ones(len(at), bool)
        own = word[at]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        before = np.cumsum(bad) - bad
        return before == np.repeat(before[first], np.diff(np.append(first, len(at))))

    def _words(self, sym: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words, and for each the number of the first equal one."""
        cut = np.ones(len(sym), bool)
        cut[1:] = ~self.beside[self._hash(sym[:-1], sym[1:])]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(sym)))
        place = np.arange(len(sym)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        mixed = (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        hashes = np.add.reduceat(mixed * powers[place], starts) ^ sizes.astype(np.uint64)
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        twin = first[same]
        if not np.array_equal(sizes[twin], sizes) or not np.array_equal(sym[np.repeat(starts[twin], sizes) + place], sym):
            twin = np.arange(len(starts))  # two words with one hash: each stands for itself
        return starts, twin

    def _encode_chunk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts (none empty), and the number of each part's ids."""
        lengths = np.array([len(p) for p in parts])
        begins = np.cumsum(lengths) - lengths
        sym = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts, twin = self._words(sym, begins)
        sizes = np.diff(np.append(starts, len(sym)))
        distinct, same = np.unique(twin, return_inverse=True)
        held, owner = self._merge(sym[_flat(starts[distinct], sizes[distinct])], np.repeat(np.arange(len(distinct), dtype=np.int32), sizes[distinct]))
        held, owner = self._as_bytes(held, owner)
        tokens = np.bincount(owner, minlength=len(distinct))
        ids = held[_flat((np.cumsum(tokens) - tokens)[same], tokens[same])]
        ends = np.append(np.cumsum(tokens[same]), 0)
        at = np.searchsorted(starts, np.append(begins, len(sym)))
        return ids, np.diff(ends[at - 1])

    def _as_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        other = sym >= OTHER
        if not other.any():
            return sym, word
        kinds, where = np.unique(sym[other], return_inverse=True)
        encoded = [chr(int(k) - OTHER).encode("utf-8", "surrogatepass") for k in kinds]
        size = np.ones(len(sym), np.int64)
        size[other] = np.array([len(e) for e in encoded])[where]
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[begin[~other]] = sym[~other]
        table, sizes = np.frombuffer(b"".join(encoded), np.uint8), np.array([len(e) for e in encoded])
        out[_flat(begin[other], size[other])] = self.bytes[table[_flat((np.cumsum(sizes) - sizes)[where], size[other])]]
        return out, np.repeat(word, size)

    def _slices(self, text: str, chunk: int) -> list[str]:
        """``text`` with its leading space, cut between words into parts of about ``chunk`` characters."""
        text, out, a = SPACE + text, [], 0
        while len(text) - a > chunk:
            low = a + chunk // 2
            while low < len(text):
                own = self.symbol[np.frombuffer(text[low : low + chunk // 2].encode("utf-32-le", "surrogatepass"), np.uint32)]
                cuts = np.flatnonzero(~self.beside[self._hash(own[:-1], own[1:])])
                if len(cuts):
                    break
                low += max(1, chunk // 2 - 1)
            else:
                break
            b = low + int(cuts[-1]) + 1
            out.append(text[a:b])
            a = b
        return [*out, text[a:]]

    def encode(self, texts: list[str], chunk: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []

        def flush() -> None:
            if held:
                ids, counts = self._encode_chunk([p for _, p in held])
                for (k, _), own in zip(held, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[k].append(own)
                held.clear()

        size = 0
        for k, text in enumerate(texts):
            for part in self._slices(text, chunk) if text else []:
                if size and size + len(part) > chunk:
                    flush()
                    size = 0
                held.append((k, part))
                size += len(part)
        flush()
        end = np.array([self.end], np.int32)
        return [np.concatenate([*own, end]) for own in out]

    # decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, in UTF-8; bytes that make no character become U+FFFD, each by itself."""
        ids = np.asarray(ids, np.int64)  # control ids have no surface, but end a run of bytes
        sizes = self.size[ids]
        out = self.surface[_flat(self.place[ids], sizes)].tobytes()
        if self.is_byte[ids].any():
            out = self._repaired(ids, out, np.cumsum(sizes))
        told = np.flatnonzero(~self.control[ids])
        return out[1:] if len(told) and self.leads[ids[told[0]]] else out

    def _repaired(self, ids: np.ndarray, out: bytes, ends: np.ndarray) -> bytes:
        if not self.control[ids[:-1]].any():
            with contextlib.suppress(UnicodeDecodeError):
                out.decode()
                return out
        parts, own = [], self.is_byte[ids]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        begins = np.append(0, ends)
        for a, b in zip(edge, np.append(edge[1:], len(ids)), strict=True):
            part = out[begins[a] : begins[b]]
            parts.append(_characters(part) if own[a] else part)
        return b"".join(parts)


def _characters(part: bytes) -> bytes:
    out, a = [], 0
    while a < len(part):
        for size in (1, 2, 3, 4):
            try:
                part[a : a + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(part[a : a + size])
            a += size
            break
        else:
            out.append("�".encode())
            a += 1
    return b"".join(out)


def _spread(batch: pa.RecordBatch, characters: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of parts of a batch of about so many characters, so that a part's ids stay small beside its texts."""
    held, size, at = [], 0, 0
    for k, text in enumerate(batch["text"]):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= characters:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, the end id last."""

    def run(batches):
        own = model(path)
        for batch in batches:
            for at, texts in _spread(batch):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, len(texts)), pa.array(own.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str, *, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id and the text that its ids stand for; null ids give null."""

    def run(batches):
        own = model(path)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id).cast("long").alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: digests of the ids and of what they decode to, without carrying either through the JVM."""

    def run(batches):
        own = model(path)
        for batch in batches:
            for at, texts in _spread(batch):
                rows = []
                for ids in own.encode(texts):
                    told = " ".join([own.decimal[i] for i in ids.tolist()])
                    rows.append((len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
