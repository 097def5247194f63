"""Word shingles as 64-bit hashes, computed on byte buffers."""

from __future__ import annotations

import numpy as np

WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of texts; keeps tables of powers that grow with the longest text."""

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 65_536)
            factors = np.full(size, _ODD), np.full(size, _INVERSE)
            for f in factors:
                f[0] = 1
            self.up, self.down = (np.multiply.accumulate(f) for f in factors)

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's windows; a text of fewer words is one window.

        A-Z are lower-cased, words are separated by ASCII white space, and a window's hash is
        that of its words joined by single spaces. No text or no word: none.
        """
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(words), dtype=np.uint8).astype(np.uint64)
        self._grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        if len(words) <= self.words:
            starts, ends = np.zeros(1, np.int64), np.array([len(raw)])
        else:
            gaps = np.flatnonzero(raw == 32)
            starts = np.concatenate([[0], gaps + 1])[: len(words) - self.words + 1]
            ends = np.concatenate([gaps, [len(raw)]])[self.words - 1 :]
        return np.unique(mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)))
