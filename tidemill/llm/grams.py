"""Hashed character n-grams of a slice of texts, without loops over characters."""

from __future__ import annotations

import numpy as np


def characters(texts: list[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a zero after each, and n + 1 bounds."""
    folded = [((t or "").lower() if fold else (t or "")) + "\0" for t in texts]
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in folded], out=bounds[1:])
    return codes, bounds


def gram_ids(codes: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashed ids of the n-grams of ``size`` characters; none spans a zero."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.full(n, size, np.uint64)
    clean = np.ones(n, bool)
    for k in range(size):
        part = codes[k : k + n]
        clean &= part != 0
        value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    at = np.flatnonzero(clean)
    return at, (value[at] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)
