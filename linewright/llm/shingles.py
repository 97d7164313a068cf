"""Word shingles as sorted sets of 64-bit numbers."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import xxhash

from linewright.llm.store import held

WORDS = re.compile(r"\w+")
#: Hashed words that a worker keeps.
REMEMBERED = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def _hashes() -> _WordHashes:
    return held(("words",), _WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over all bits of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct shingles of ``n`` words, sorted. Words are runs of letters, digits and ``_`` in lower case.

    A text with fewer words is one shingle, a text without words has none.
    """
    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes().__getitem__
    hashed = np.fromiter(map(get, words), np.uint64, len(words))
    n = min(n, len(words))
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * np.uint64(_BASE) + hashed[i : i + count]
    return np.unique(mixed(total + np.uint64(n)))


def set_mark(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()
