"""Character n-grams of whole texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def codes(text: str) -> np.ndarray:
    """The code points of text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def rolling(c: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hashes of all n-grams, by doubling: as many steps as n has binary digits."""
    if len(c) < n:
        return np.empty(0, np.uint64)
    part, width, power = c.astype(np.uint64), 1, _M
    out, have, out_power = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                out = part if out is None else out[: len(c) - have - width + 1] * power + part[have : have + len(c) - have - width + 1]
                have += width
            if have == n:
                return out
            part = part[: len(part) - width] * power + part[width:]
            width, power = width * 2, power * power


def grams(text: str, n: int) -> np.ndarray:
    """Hashes of all n-grams of text, in order; none if text is shorter than n."""
    with np.errstate(over="ignore"):
        return mix(rolling(codes(text), n))


def squeezed(text: str) -> str:
    """text without any white space, in lower case."""
    return "".join(text.split()).lower()


class GramTable:
    """Looks up gram hashes in a fixed set: a bit map first, then an exact search for what passes it."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.keys = np.unique(hashes)
        self.mask = np.uint64((1 << bits) - 1)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are in the set, and their indices in self.keys."""
        at = np.flatnonzero(self.map[h & self.mask])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]
