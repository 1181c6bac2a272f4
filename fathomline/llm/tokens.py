"""Loading of public vocabularies, and token ids of whole texts.

The path of a vocabulary file is always a parameter; files are opened where a task runs.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

#: Texts with a character outside these take the slower library, whose pattern engine has its own Unicode tables.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a0-\\u024f]")


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def json_tokenizer(path: str, special: bool):
    """The tokenizer; strings of its special tokens stand for their ids in a text if ``special``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


@functools.lru_cache(maxsize=4)
def special_strings(path: str) -> list[str]:
    """Read from the file itself, since the tokenizer takes over 100 MB of a worker that may not need it."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


class DocumentIds:
    """ids of a text as the tokenizer file at ``json_path`` gives them, with no special token added.

    The string of a special token in a text gives its id, as the library does by itself; with ``special=False`` it is ordinary text.
    The same vocabulary as ranks (``rank_path``) is about four times as fast and gives the same ids; it encodes texts of plain Latin
    characters without such a string, on which the tests compare the two libraries character by character. All other texts go to ``tokenizers``."""

    def __init__(self, json_path: str, rank_path: str | None = None, pattern: str | None = None, special: bool = True) -> None:
        self.json_path, self.rank_path, self.pattern, self.special = json_path, rank_path, pattern, special
        self.name = f"{os.path.basename(json_path)}{' special' if special else ''}"

    def __call__(self, text: str) -> list[int]:
        if self.rank_path and not PLAIN.search(text) and not (self.special and any(m in text for m in special_strings(self.json_path))):
            return rank_encoding(self.rank_path, self.pattern).encode_ordinary(text)
        return json_tokenizer(self.json_path, self.special).encode(text, add_special_tokens=False).ids


def little_endian(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()
