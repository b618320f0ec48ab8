"""Vectorised word and substring hashing over one text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Longest word in bytes that the running sums hash; the polynomial modulo 2**64 behind them is not safe for long ones.
LONGEST_WORD = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240517).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    """Powers of the multiplier and of its inverse modulo 2**64, up to the n-th."""
    global _powers, _inverses
    if n <= len(_powers):
        return
    n = 1 << (n - 1).bit_length()
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    with np.errstate(over="ignore"):
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _MULTIPLIER))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, inverse))])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, joined by single blanks, with hashes of any run of them."""

    def __init__(self, text: str | None):
        self.joined = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
        data = np.frombuffer(self.joined, dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        if len(data):
            self.starts = np.concatenate([[0], blanks + 1])
            self.ends = np.append(blanks, len(data))
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self._data, self._hashes = data, None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hashes is None:
            _grow(len(self._data) + 1)
            sums = np.zeros(len(self._data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self._data] * _powers[: len(self._data)], out=sums[1:])
            s, e = self.starts, self.ends
            self._hashes = mix((sums[e] - sums[s]) * _inverses[s] + (e - s).astype(np.uint64))
            for i in np.flatnonzero(e - s > LONGEST_WORD).tolist():
                self._hashes[i] = xxhash.xxh3_64_intdigest(self.joined[s[i] : e[i]])
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """A 64-bit hash of each run of k consecutive words, of their hashes."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        words = self.hashes()
        out = words[:n].copy()
        for j in range(1, k):
            out *= _MULTIPLIER
            out += words[j : j + n]
        return mix(out + np.uint64(k))

    def run(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last``, both included, with single blanks between."""
        return self.joined[self.starts[first] : self.ends[last]]

    def list(self) -> list[bytes]:
        return self.joined.split(b" ") if self.joined else []


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted; of all its words if they are fewer; none if it has none."""
    words = Words(text)
    return np.unique(words.grams(min(k, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)
