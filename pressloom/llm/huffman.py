"""Canonical length-limited Huffman codes over integer ids, in blocks that decode by themselves."""

from __future__ import annotations

import struct

import numpy as np

#: Longest code; decoding looks so many bits up in one table.
LONGEST = 18
#: Ids of a block, and blocks that are decoded side by side.
BLOCK, SIDE_BY_SIDE = 256, 4096
_HEAD = struct.Struct("<4sIQ")
_MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each of ``counts`` > 0, the least total that no code above ``longest`` allows, by package merging."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError(f"{n} ids have no codes of {longest} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        items = np.concatenate([leaves, packages])
        merged = np.argsort(items, kind="stable")
        levels.append(merged < n)
        items = items[merged]
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ``ids`` (ascending) with code ``lengths``: shorter codes first, equal ones by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.longest = int(lengths.max()) if len(ids) else 1
        spans = (1 << (self.longest - lengths[order])).astype(np.int64)
        starts = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 0
        self.length_of, self.code_of = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        self.length_of[ids], self.code_of[ids[order]] = lengths, starts >> (self.longest - lengths[order])
        # what each window of `longest` bits begins with
        used = int(spans.sum())
        self.id_at, self.length_at = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
        self.id_at[:used], self.length_at[:used] = np.repeat(ids[order], spans), np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> bytes:
        """A header, the bit offset at which every block of ``block`` ids begins, and the codes."""
        lengths = self.length_of[ids].astype(np.int64)
        if len(ids) and not lengths.all():
            raise ValueError("an id has no code")
        at = np.cumsum(lengths) - lengths
        head = _HEAD.pack(_MAGIC, block, len(ids)) + at[::block].astype("<u8").tobytes()
        if not len(ids):
            return head
        n_bits = int(at[-1] + lengths[-1])
        # a code that begins in a word of 32 bits ends in the next one at the latest
        word = at >> 5
        placed = self.code_of[ids] << (64 - (at & 31) - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        both, word = np.bitwise_or.reduceat(placed, first), word[first]
        words = np.zeros(n_bits // 32 + 2, np.uint32)
        words[word] = both >> np.uint64(32)
        words[word + 1] |= both.astype(np.uint32)
        return head + words.astype(">u4").tobytes()[: -(-n_bits // 8)]

    def decode(self, coded: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` (not included), all by default; no other block is read."""
        magic, block, n = _HEAD.unpack_from(coded)
        if magic != _MAGIC:
            raise ValueError("these bytes are no coded ids")
        blocks = -(-n // block)
        offsets = np.frombuffer(coded, "<u8", blocks, _HEAD.size).astype(np.int64)
        body = _HEAD.size + 8 * blocks
        last = blocks if last is None else min(last, blocks)
        out = [np.zeros(0, np.uint32)]
        for low in range(first, last, SIDE_BY_SIDE):
            high = min(low + SIDE_BY_SIDE, last)
            begin = int(offsets[low]) >> 3
            end = len(coded) - body if high == blocks else (int(offsets[high]) >> 3) + 1
            data = np.frombuffer(coded[body + begin : body + end] + bytes(block * self.longest // 8 + 8), np.uint8).astype(np.uint32)
            windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
            at = offsets[low:high] - 8 * begin
            ids = np.empty((block, high - low), np.uint32)
            shift = 32 - self.longest
            mask = (1 << self.longest) - 1
            for k in range(min(block, n - low * block)):
                code = (windows[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
                ids[k] = self.id_at[code]
                at = np.minimum(at + self.length_at[code], 8 * len(windows) - 1)
            out.append(ids.T.ravel()[: n - low * block])
        return np.concatenate(out)
