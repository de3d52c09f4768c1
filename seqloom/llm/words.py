"""Words and texts, as the text operators of this subpackage see them.

A word is a run of characters other than space and the control characters 0x09 to 0x0D. For
UTF-8 bytes that is what ``bytes.split()`` does; for Spark it is ``WORD``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

_MIX = np.uint64(0x9E3779B97F4A7C15)


def lower_az(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8; of a null text none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(TO_LOWER) if lower else data).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the whole value."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each window of ``k`` words in a row; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * _MIX + hashes[j : j + n])
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``k`` words count as one shingle, no word as none."""
    if len(hashes) >= k:
        return np.unique(windows(hashes, k))
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return windows(mix(hashes + np.uint64(len(hashes))), len(hashes))
