"""64-bit hashes of words and of runs of words, by numpy over whole documents."""

from __future__ import annotations

import numpy as np
import xxhash

from convosieve.llm.common import Memo, per_process

# Odd factors of the polynomial and the finaliser of splitmix64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def word_hashes() -> Memo:
    return per_process(("word hashes",), lambda: Memo(xxhash.xxh3_64_intdigest))


def hashed(words: list[bytes], memo: Memo) -> np.ndarray:
    out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    memo.trim()
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of all runs of any length of one document: differences of a polynomial's prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        powers = np.full(self.n + 1, BASE, np.uint64)
        powers[0] = 1
        back = np.full(self.n + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * np.multiply.accumulate(powers)[:-1], out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        """One hash for each start, none if the document is shorter."""
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:m]) * self.back[:m])
