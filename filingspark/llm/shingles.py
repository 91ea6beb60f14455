"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .simhash import _ASCII_LOWER

SHINGLE = 5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's shingles in order, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not w:
        return np.zeros(0, "u8")
    of_words = np.fromiter(map(xxhash.xxh64_intdigest, w), "u8", len(w))
    n = max(1, len(w) - shingle + 1)
    out = np.zeros(n, "u8")
    for k in range(min(shingle, len(w))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + of_words[k : k + n]
    return _mixed(out)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles."""
    return np.unique(hashes(text, shingle))
