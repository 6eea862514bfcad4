"""Canonical length-limited Huffman coding of token ids, in independent blocks with checkpoints.

All of it is vectorised: encoding writes the bits of a whole block at once, and
decoding walks many stretches in step, one table look-up for a symbol of each.

A block on disk::

    "HTB1" | n ids, n checkpoints, payload bytes (uint32 each) | checkpoints (uint32 bit offsets, one every CHECK ids) | payload

Codes are written from the highest bit of each byte on, as canonical codes are.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

MAX_BITS = 18
CHECK = 256
MAGIC = b"HTB1"
_HEAD = struct.Struct("<4sIII")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols by count (0: no code), by package-merge.

    One symbol alone gets a code of one bit.
    """
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n == 0:
        return lengths
    if n == 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts[symbols], kind="stable")
    weight = counts[symbols][order].astype(np.int64)
    # level by level, cheapest first: the leaves merged with the pairs of the level below. What counts is only
    # how many leaves each level takes, since a prefix of the sorted leaves is taken each time.
    levels, merged = [], weight
    is_leaf = np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        leaf = np.concatenate((np.ones(n, bool), np.zeros(len(pairs), bool)))
        at = np.argsort(both, kind="stable")
        merged = both[at]
        levels.append(leaf[at])
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[symbols[order]] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of some code lengths: by length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    used = np.flatnonzero(lengths)
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self.bits = int(self.lengths.max()) if len(self.lengths) else 0
        self._symbol = self._length = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next ``bits`` bits: the symbol and the length of its code."""
        if self._symbol is None:
            symbol, length = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint8)
            used = np.flatnonzero(self.lengths)
            used = used[np.argsort(self.lengths[used], kind="stable")]
            spans = 1 << (self.bits - self.lengths[used].astype(np.int64))
            total = int(spans.sum())
            symbol[:total] = np.repeat(used, spans)  # canonical codes fill the table in order
            length[:total] = np.repeat(self.lengths[used], spans)
            self._symbol, self._length = symbol, length
        return self._symbol, self._length

    def encode(self, ids: np.ndarray, check: int = CHECK) -> bytes:
        if not len(ids):
            return _HEAD.pack(MAGIC, 0, 0, 0)
        n = self.lengths[ids].astype(np.int64)
        if not n.all():
            raise ValueError("an id has no code")
        end = np.cumsum(n)
        begin = end - n
        word = begin >> 5
        # a code of up to 25 bits lies within the 64 bits from its 32-bit word on
        value = self.codes[ids].astype(np.uint64) << (64 - (begin & 31) - n).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(value, first)  # codes do not overlap, so adding is or-ing
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        out[word[first]] = sums >> np.uint64(32)
        out[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)  # each word once
        payload = out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8]
        points = begin[::check].astype("<u4")
        return _HEAD.pack(MAGIC, len(ids), len(points), len(payload)) + points.tobytes() + payload

    def decode(self, block: bytes, check: int = CHECK) -> np.ndarray:
        """All ids of a block: every stretch between checkpoints is decoded in step with the others."""
        magic, n, points, size = _HEAD.unpack_from(block)
        if magic != MAGIC or len(block) != _HEAD.size + 4 * points + size:
            raise ValueError("not a block of this format, or a damaged one")
        if not n:
            return np.zeros(0, np.uint32)
        at = np.frombuffer(block, "<u4", points, _HEAD.size).astype(np.int64)
        return self._walk(block[_HEAD.size + 4 * points :], at, n, check)

    def decode_range(self, block: bytes, start: int, count: int, check: int = CHECK) -> np.ndarray:
        """``count`` ids from number ``start`` on, decoding only the stretches they lie in."""
        _, n, points, _ = _HEAD.unpack_from(block)
        if not 0 <= start <= start + count <= n:
            raise ValueError("outside the block")
        if not count:
            return np.zeros(0, np.uint32)
        a, b = start // check, (start + count - 1) // check + 1
        at = np.frombuffer(block, "<u4", points, _HEAD.size)[a:b].astype(np.int64)
        ids = self._walk(block[_HEAD.size + 4 * points :], at, min(n, b * check) - a * check, check)
        return ids[start - a * check :][:count]

    def _walk(self, payload: bytes, at: np.ndarray, n: int, check: int) -> np.ndarray:
        symbol, length = self.tables()
        padded = payload + bytes(8)
        # 32 bits from any byte on, highest first
        window = np.ndarray((len(payload) + 4,), ">u4", padded, 0, (1,))
        shift = 32 - self.bits
        mask = np.uint32((1 << self.bits) - 1)
        out = np.zeros((check, len(at)), np.uint32)
        last = n - (len(at) - 1) * check  # ids in the last stretch
        limit = len(payload)
        for k in range(min(check, n)):
            if k == last and len(at) > 1:
                at = at[:-1]
            i = np.minimum(at >> 3, limit)
            bits = (window[i].astype(np.uint32) >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[k, : len(at)] = symbol[bits]
            at = at + length[bits]
        return out.T.ravel()[:n] if n > check else out[:n, 0]


def limited(counts: np.ndarray, limit: int = MAX_BITS) -> Codec:
    """The code for these counts; more symbols than ``limit`` bits can tell apart raise the limit."""
    used = int(np.count_nonzero(counts))
    return Codec(code_lengths(counts, max(limit, (used - 1).bit_length() if used > 1 else 1)))


def average_bits(counts: np.ndarray, lengths: np.ndarray) -> float:
    return float((counts * lengths).sum() / max(1, counts.sum()))


def plain_lengths(counts: np.ndarray) -> int:
    """The cost in bits of an unlimited Huffman code (for tests)."""
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost
