"""Minimal perfect hashing of 64-bit keys: n keys get the numbers 0 to n-1, in a few bits each.

Keys are split into buckets by a hash. A bucket's keys are hashed into a bit
array; keys that are alone at their bit stay there, and the others go to the
next, smaller array. A key's number is the number of set bits before its own, over
all buckets in a row. Other keys get some number or none, so the keys themselves
are kept in the order of their numbers and compared.
"""

from __future__ import annotations

import numpy as np

from pressloom.llm.words import constants, mix

_U = np.uint64
#: Bits for each key that a level begins with, the most levels, and the bits of the hash that chooses buckets.
LOAD, LEVELS, BUCKET_BITS = 2.0, 64, 16
_SEEDS = constants(LEVELS, 53)


def bucket_hash(keys: np.ndarray) -> np.ndarray:
    """``BUCKET_BITS`` bits of each key, from which its bucket follows."""
    return (mix(keys.astype(_U) ^ _U(0x5DEECE66D)) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, their words, and the distinct ``keys`` in the order of their numbers."""
    sizes, words, placed, rest = [], [], [], keys.astype(_U)
    for level in range(LEVELS):
        if not len(rest):
            break
        size = -(-int(LOAD * len(rest)) // 64) * 64
        at = (mix(rest ^ _SEEDS[level]) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        placed.append(rest[alone][np.argsort(at[alone])])
        rest = rest[~alone]
    if len(rest):
        raise ValueError("keys are repeated")
    join = lambda parts: np.concatenate([np.zeros(0, _U), *parts])
    return np.array(sizes, np.int64), join(words), join(placed).astype(np.int64)


class PerfectHash:
    """Numbers of keys from the structures of all buckets, in the order of the buckets."""

    def __init__(self, sizes: list[np.ndarray], words: list[np.ndarray], keys: list[np.ndarray]) -> None:
        depth = max([1, *map(len, sizes)])
        self.size = np.zeros((len(sizes), depth), np.int64)
        for own, row in zip(sizes, self.size, strict=True):
            row[: len(own)] = own
        ends = np.cumsum(self.size.ravel()).reshape(self.size.shape)
        self.base = ends - self.size
        self.words = np.concatenate([np.zeros(0, _U), *words])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that is not among the verified ones stops with an error."""
        out = np.full(len(keys), -1, np.int64)
        rest, own = np.arange(len(keys)), keys.astype(_U)
        bucket = bucket_hash(keys) * len(self.size) >> BUCKET_BITS
        for level in range(self.size.shape[1]):
            size = self.size[bucket, level]
            there = size > 0
            if not there.all():
                rest, own, bucket, size = rest[there], own[there], bucket[there], size[there]
            if not len(rest):
                break
            bit = self.base[bucket, level] + (mix(own ^ _SEEDS[level]) % size.astype(_U)).astype(np.int64)
            word, inside = self.words[bit >> 6], (bit & 63).astype(_U)
            hit = (word >> inside & _U(1)).astype(bool)
            below = word[hit] & ((_U(1) << inside[hit]) - _U(1))
            out[rest[hit]] = self.before[bit[hit] >> 6] + np.bitwise_count(below)
            rest, own, bucket = rest[~hit], own[~hit], bucket[~hit]
        if len(keys) and (out.min() < 0 or (self.keys[out] != keys).any()):
            raise ValueError("an unknown key")
        return out
