"""Vectorised word and window arithmetic shared by the operators.

Words are runs of bytes other than ASCII white space (``bytes.split``), so they are
the same on UTF-8 bytes as ``[^\\x20\\x09-\\x0D]+`` is on text.

Word hashes take a word's bytes eight at a time, each through a 64-bit mixer, so words
of up to eight bytes with equal lengths never share a hash, and no pattern of letters
makes longer ones meet. Window hashes of the first family mix halves together, of 1, 2,
4 ... words, which leaves no arithmetic structure either; those of the second are
polynomials over word hashes of another seed, so the two families are independent.
Everything here is position-independent: equal words or windows get equal values
in any document, process or run.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_WORD_BASE = 0xA0761D6478BD642F
_LENGTH, _JOIN, _SECOND = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0x5851F42D4C957F2D)
#: Keeps the first n bytes of a little-endian lane.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed by XXH64.
_LANES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (a bijection)."""
    x = x ^ (x >> U64(33))
    x *= _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand up to ``LIMIT``."""

    LIMIT = 1 << 21

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = (self._run(b, m) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _run(base: int, m: int) -> np.ndarray:
        out = np.full(m, U64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_WORD_POWERS = _Powers(_WORD_BASE)


def bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a text whose words are joined by one space."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.empty(len(gaps) + 1, np.int64)
    starts[0], starts[1:] = 0, gaps + 1
    ends = np.empty(len(gaps) + 1, np.int64)
    ends[-1], ends[:-1] = len(joined), gaps
    return starts, ends


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word ``joined[starts[i]:ends[i]]``; ``seed`` picks one of many independent families."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray((len(joined) + 1,), "<u8", joined + bytes(8), 0, (1,))
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _LENGTH + U64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    out = mix(out ^ (lanes[starts] & _FIRST[np.minimum(lengths, 8)]))
    long = np.flatnonzero(lengths > 8)
    if len(long):
        longest = int(lengths.max())
        if longest > 8 * _LANES:
            huge = long[lengths[long] > 8 * _LANES]
            out[huge] = [xxhash.xxh64_intdigest(joined[starts[i] : ends[i]], seed) for i in huge.tolist()]
            long = long[lengths[long] <= 8 * _LANES]
        for k in range(8, min(longest, 8 * _LANES), 8):
            long = long[lengths[long] > k]
            out[long] = mix(out[long] * _JOIN + (lanes[starts[long] + k] & _FIRST[np.minimum(lengths[long] - k, 8)]))
    return out


def lane_mask(n: np.ndarray) -> np.ndarray:
    """Masks that keep the first ``n`` bytes of lanes; less than none is none, more than eight are eight."""
    return _FIRST[np.clip(n, 0, 8)]


def _merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash for each pair of hashes, in which their order counts."""
    x = (left ^ (left >> U64(29))) * _JOIN + right
    x ^= x >> U64(32)
    x *= _M1
    x ^= x >> U64(29)
    return x


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` consecutive words, joined from runs of 1, 2, 4 ... words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            out = run[:n] if out is None else _merged(out, run[done : done + n])
            done += size
        if done == width:
            return mix(out ^ U64(width))
        run = _merged(run[: len(run) - size], run[size:])
        size *= 2


def second_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The second family: a polynomial modulo 2**64 over word hashes (of another seed) for each run of ``width`` words, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = _Powers.LIMIT >> 1
    for i in range(0, n, step):
        j = min(n, i + step)
        part = words[i : j + width - 1]
        up, down = _WORD_POWERS.get(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i:j] = mix((sums[width:] - sums[:-width]) * down[: j - i] + _SECOND)
    return out


def covered(n_words: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of ``n_words`` words lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, np.minimum(starts + width, n_words), 1)
    return np.cumsum(steps[:-1]) > 0


def mask_ranges(mask: np.ndarray) -> np.ndarray:
    """The runs of True as a flat array start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return edge.astype(np.int64)


def ranges_mask(n: int, ranges: Iterable[int] | None) -> np.ndarray:
    out = np.zeros(n, bool)
    if ranges is not None:
        r = np.asarray(ranges, np.int64)
        for a, b in zip(r[::2].tolist(), r[1::2].tolist(), strict=True):
            out[a:b] = True
    return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def each_text(column: pa.Array, rows: int = 500) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, of which only some rows are copied at a time."""
    for i in range(0, len(column), rows):
        yield from as_bytes(column.slice(i, rows))


def trimmed(items: Iterator) -> Iterator:
    """The same items; memory that the worker has freed goes back to the system at the end, as idle workers live on."""
    try:
        yield from items
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes, so that work arrays stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
