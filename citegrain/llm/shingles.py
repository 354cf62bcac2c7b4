"""Five-word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Words whose hashes a worker keeps.
CACHE_WORDS = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_KNOWN = _Hashes()
forget_words = _KNOWN.clear


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: just what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending distinct hashes (uint64). Fewer than five words: their whole sequence; none: empty."""
    if len(_KNOWN) > CACHE_WORDS:
        _KNOWN.clear()
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = _mixed(x * _MIX[0] + h[k : k + n])
    return np.unique(x)
