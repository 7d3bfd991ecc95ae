"""Words and weighted word shingles of texts, hashed; shared by the operators on near copies."""

from __future__ import annotations

import string
from collections.abc import Iterable

import numpy as np
import xxhash

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8; ASCII punctuation and white space part them."""
    return text.lower().encode().translate(_PUNCTUATION).split()


class WordHashes(dict):
    """64-bit hashes by word, kept in two generations of bounded size."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.old = limit, {}

    def __missing__(self, word: bytes) -> int:
        known = self.old.get(word)
        known = self[word] = xxhash.xxh3_64_intdigest(word) if known is None else known
        return known

    def of(self, parts: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of that many words; a shorter text is one shingle of all its words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return out


def weighted(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their weights, 1 + ln(occurrences)."""
    if not len(hashed):
        return hashed, np.zeros(0)
    distinct, count = np.unique(hashed, return_counts=True)
    return distinct, 1 + np.log(count)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i); two empty sets are equal.

    For sets without weights that is Jaccard's index. max(a_j / a_i, b_j / b_i) is the first where
    b_j / a_j <= b_i / a_i, so that one sort by this ratio gives all inner sums.
    """
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_x, only_y = wx.sum() - wx[ix].sum(), wy.sum() - wy[iy].sum()
    p, q = wx[ix], wy[iy]
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    upto = np.searchsorted(ratio, ratio * (1 + 1e-12), side="right")
    sum_p = np.concatenate([[0.0], np.cumsum(p)])[upto] + only_x
    sum_q = q.sum() - np.concatenate([[0.0], np.cumsum(q)])[upto] + only_y
    return float((1 / (sum_p / p + sum_q / q)).sum())


def text_shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return weighted(shingles(hashes.of(words(text))))


def normal_key(text: str, parts: Iterable[bytes]) -> bytes:
    """128 bits that texts of equal words share; a text without words is known by its characters."""
    joined = b" ".join(parts)
    return xxhash.xxh3_128_digest(joined or b"\x00" + text.encode())
