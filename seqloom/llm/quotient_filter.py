"""Counting quotient filters of packed word-id n-grams, as sorted arrays.

Three word ids (the last 0 for a pair) are packed side by side into a key of ``2 * half`` bits, and
a Feistel network permutes the keys: the order of the permuted keys looks random, and each key can
be had back. The leading bits are the shard, the next ones the quotient, and all others are kept as
the remainder, so nothing is lost and counts are exact. A filter of n keys has about n quotients;
how many keys each has is written in unary, remainders as bytes, counters as one byte with wider
ones apart: 3 to 6 bytes a key for vocabularies up to a million words. Filters are sorted, so those
of one shard are merged by merging their keys and adding up their counters.
"""

from __future__ import annotations

import struct

import numpy as np

from seqloom.llm.words import mix

ROUNDS = 4
_HEAD = struct.Struct("<QBBQ")  # keys, quotient bits, remainder bytes, wide counters


def half_bits(word_bits: int) -> int:
    """Bits of each half of a key of three words."""
    return (3 * word_bits + 1) // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the keys of three words."""
    h, w = half_bits(word_bits), word_bits
    low = (c | (b << np.uint64(w))) & _mask(h)  # what is shifted out lies above the half
    return (a << np.uint64(2 * w - h)) | (b >> np.uint64(h - w)), low


def unpack(high: np.ndarray, low: np.ndarray, word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three words of each key."""
    h, w = half_bits(word_bits), word_bits
    middle = ((low >> np.uint64(w)) | (high << np.uint64(h - w))) & _mask(w)
    return high >> np.uint64(2 * w - h), middle, low & _mask(w)


def _round(x: np.ndarray, i: int, half: int) -> np.ndarray:
    return mix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) & _mask(half)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of keys."""
    for i in range(ROUNDS):
        high, low = low, high ^ _round(low, i, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    for i in reversed(range(ROUNDS)):
        high, low = low ^ _round(high, i, half), high
    return high, low


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (1 each if None)."""
    if half <= 32:  # a whole key fits 64 bits
        key = (high << np.uint64(half)) | low
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        fresh = key[1:] != key[:-1]
        high, low = key >> np.uint64(half), key & _mask(half)
    else:
        order = np.lexsort((low, high))
        high, low, counts = high[order], low[order], None if counts is None else counts[order]
        fresh = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(np.append(len(high) > 0, fresh))
    if counts is None:
        total = np.diff(np.append(first, len(high)))
    else:
        total = np.add.reduceat(counts, first) if len(first) else counts
    return high[first], low[first], total.astype(np.int64)


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, shard_bits: int) -> bytes:
    """A filter of distinct sorted keys that agree in their first ``shard_bits`` bits."""
    n = len(high)
    quotient_bits = max(0, min(n.bit_length() - 1, half - shard_bits))
    rest = half - shard_bits - quotient_bits  # bits of the upper half that are in the remainder
    quotient = ((high & _mask(half - shard_bits)) >> np.uint64(rest)).astype(np.int64)
    unary = np.zeros(n + (1 << quotient_bits), np.uint8)
    unary[quotient + np.arange(n)] = 1  # a one a key, a zero at the end of each quotient
    upper, lower = (rest + 7) // 8, (half + 7) // 8
    planes = [((x >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for x, k in ((high & _mask(rest), upper), (low, lower)) for i in range(k)]
    wide = counts >= 255
    narrow = np.where(wide, 255, counts).astype(np.uint8)
    head = _HEAD.pack(n, quotient_bits, upper + lower, int(wide.sum()))
    return b"".join([head, np.packbits(unary).tobytes(), *(x.tobytes() for x in planes), narrow.tobytes(), counts[wide].astype("<i8").tobytes()])


def decode(data: bytes, half: int, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counters of a filter, sorted."""
    n, quotient_bits, _, wide = _HEAD.unpack_from(data)
    at, size = _HEAD.size, n + (1 << quotient_bits)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size)
    at += (size + 7) // 8
    quotient = (np.flatnonzero(unary) - np.arange(n)).astype(np.uint64)
    rest = half - shard_bits - quotient_bits
    parts = []
    for k in ((rest + 7) // 8, (half + 7) // 8):
        x = np.zeros(n, np.uint64)
        for i in range(k):
            x |= np.frombuffer(data, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * i)
            at += n
        parts.append(x)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    if wide:
        counts[counts == 255] = np.frombuffer(data, "<i8", wide, at + n)
    return (np.uint64(shard) << np.uint64(half - shard_bits)) | (quotient << np.uint64(rest)) | parts[0], parts[1], counts


def split(high: np.ndarray, half: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted keys fall into, and where each begins and the last ends."""
    shard = high >> np.uint64(half - shard_bits)
    begins = np.flatnonzero(np.append(len(shard) > 0, shard[1:] != shard[:-1]))
    return shard[begins].astype(np.int64), np.append(begins, len(shard))


def merge(filters: list[bytes], half: int, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all filters of a shard, sorted, with the sums of their counters."""
    parts = [decode(x, half, shard_bits, shard) for x in filters]
    high, low, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return summed(high, low, counts, half)
