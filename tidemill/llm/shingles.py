"""Vectorised hashing of words and word shingles over Arrow batches.

A batch of texts is one byte buffer.  ASCII letters are folded by a table, words are found from the
separator bytes, every word gets a 64-bit hash from prefix sums of its bytes, and a shingle combines
the mixed hashes of its words in order.  Nothing loops over words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _inverse(value: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    return pow(value, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    if count:
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first : int(offsets[-1])], offsets - first


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters and digits of ASCII, and all bytes of other characters.
_SIGN = np.ones(256, bool)
_SIGN[:128] = [chr(b).isalnum() for b in range(128)]


class Words:
    """The words of a batch: hashes in order, and per document the range of its words.

    With ``trim`` words lose ASCII punctuation at both edges, and words of nothing else are left
    out; ``number`` is the place of each word among all words of its document.
    """

    def __init__(self, column: pa.Array, trim: bool = False):
        raw, offsets = byte_buffer(column)
        folded = _FOLD[raw]
        inside = ~_SPACE[raw]
        before = np.empty(len(raw) + 1, bool)
        before[0] = False
        before[1:] = inside
        # a document's first byte always opens a new word, so words never span documents
        cut = offsets[:-1]
        opens = inside & ~before[:-1]
        at = cut[cut < len(raw)]
        opens[at] |= inside[at]
        starts = np.flatnonzero(opens)
        space = np.flatnonzero(~inside)
        next_space = np.append(space, len(raw))[np.searchsorted(space, starts)]
        ends = np.minimum(next_space, offsets[np.searchsorted(offsets, starts, side="right")]) if len(starts) else next_space
        self.first = np.searchsorted(starts, offsets)  # n + 1 bounds into the words
        if trim:
            number = np.arange(len(starts)) - np.repeat(self.first[:-1], np.diff(self.first))
            sign = np.append(np.flatnonzero(_SIGN[raw]), len(raw))
            begin = sign[np.searchsorted(sign, starts)]
            kept = begin < ends
            self.first = np.append(0, np.cumsum(kept))[self.first]
            starts, ends, self.number = begin[kept], ends[kept], number[kept]
            ends = sign[np.searchsorted(sign, ends) - 1] + 1
        self.hashes = _word_hashes(folded, starts, ends)
        self.starts, self.ends, self.offsets, self.raw = starts, ends, offsets, raw


_BLOCK = 1 << 20


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of data[start:end], finalised together with the length."""
    out = np.empty(len(starts), np.uint64)
    powers = _powers(_BASE, _BLOCK * 2 + 1)
    inverse = _powers(np.uint64(_inverse(int(_BASE))), _BLOCK + 1)
    done = 0
    while done < len(starts):
        begin = int(starts[done])
        upto = int(np.searchsorted(starts, begin + _BLOCK))
        upto = max(upto, done + 1)
        end = int(ends[upto - 1])
        if end - begin > len(powers) - 1:
            powers = _powers(_BASE, end - begin + 1)
        total = np.zeros(end - begin + 1, np.uint64)
        np.cumsum((data[begin:end].astype(np.uint64) + np.uint64(1)) * powers[: end - begin], out=total[1:])
        s, e = starts[done:upto] - begin, ends[done:upto] - begin
        out[done:upto] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP
        done = upto
    return mix(out)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and n + 1 bounds per document.

    A document with fewer words has one shingle, its whole sequence; one without words has none.
    """
    count = np.diff(words.first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=bounds[1:])
    total = int(bounds[-1])
    position = np.arange(total) - np.repeat(bounds[:-1], runs) + np.repeat(words.first[:-1], runs)
    length = np.repeat(np.minimum(count, size), runs)
    out = np.zeros(total, np.uint64)
    last = len(words.hashes) - 1
    for k in range(size):
        word = words.hashes[np.minimum(position + k, last)] if total else out
        use = length > k
        out = np.where(use, mix(out * _STEP + word + np.uint64(k + 1)), out)
    return out, bounds


def distinct_per_document(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document and the new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner)) if len(hashes) else np.zeros(0, np.int64)
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(bounds)))


def minima_columns(hashes: np.ndarray, count: int, seed: int = 1) -> Iterator[np.ndarray]:
    """The hashes under each of the multiply-add functions of ``minhash``, one function at a time."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(count):
        yield ((hashes * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)


def minhash(hashes: np.ndarray, bounds: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """An (n, count) table of 32-bit minima, one column per multiply-add function; empty sets get 2**32 - 1."""
    n = len(bounds) - 1
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if not len(filled):
        return out
    at = bounds[filled]
    for k, high in enumerate(minima_columns(hashes, count, seed)):
        out[filled, k] = np.minimum.reduceat(high, at)
    return out
