"""Token ids of a byte-level BPE vocabulary, with a cache of words per Python worker.

The vocabulary's pre-tokeniser never joins characters across a single space between two other
characters, so a text is cut there and each part, with its leading space, is encoded by itself.
Most parts repeat, which makes this several times faster than encoding whole texts; the ids are the
same (``tests/llm`` compares them with the ``tokenizers`` library).  The vocabulary's added tokens,
such as ``<|endoftext|>``, are found first wherever their string stands and become one id; the text
between them is encoded by itself, as that library does.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Cached parts per worker, unless asked otherwise (some 200 bytes each, kept as long as the worker lives), and their longest length.
CACHE, CACHED_LENGTH = 500_000, 40


class _Irregular(Exception):
    """A part begins or ends with white space, so cutting at every space was wrong."""


class _Parts(dict):
    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def ids(self, part: str) -> bytes:
        return np.array(self.encode(self.lead + part), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Irregular
        ids = self.ids(part)
        if len(part) <= CACHED_LENGTH:
            self[part] = ids
        return ids


def added_tokens(vocabulary_path: str) -> dict[str, int]:
    """The strings that a ``tokenizers`` vocabulary file maps to one id before anything else."""
    with open(vocabulary_path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in listed):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    return {t["content"]: t["id"] for t in listed}


class Encoder:
    """``encode(text)`` gives little-endian unsigned 32-bit ids; ``added`` strings are single ids."""

    def __init__(self, ranks_path: str, pattern: str, added: Mapping[str, int] | None = None, cache: int = CACHE):
        import tiktoken

        self.cache = cache
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        plain = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Parts(plain.encode_ordinary, ""), _Parts(plain.encode_ordinary, " ")

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if len(self.first) + len(self.rest) > self.cache:
            self.first.clear()
            self.rest.clear()
        try:
            head, *rest = text.split(" ")
            return self.first[head] + b"".join(map(self.rest.__getitem__, rest))
        except _Irregular:
            head, *rest = _CUT.split(text)
            return self.first.ids(head) + b"".join(map(self.rest.ids, rest))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str, added: Mapping[str, int] | None = None, cache: int = CACHE) -> Encoder:
    """The worker's encoder, loaded once."""
    key = (ranks_path, pattern, cache, *sorted((added or {}).items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_path, pattern, added, cache)
    return _ENCODERS[key]
