"""Words and word shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import regex
import xxhash

#: Words of a shingle; words whose numbers a worker keeps.
SHINGLE, KNOWN_WORDS = 5, 200_000
#: Words are runs of letters, digits and underscores, in lower case.
WORD = regex.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit numbers of words and shingles."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def numbers(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode())
            return np.array([known[w] for w in words], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The numbers of all shingles of `size` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = words[:n].copy()
    for k in range(1, size):
        out *= MIX
        out += words[k : k + n]
    return mixed(out)
