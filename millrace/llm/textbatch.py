"""Vectorised words, hashes and shingles over Arrow string batches.

Words are found on UTF-8 bytes: every separator here is ASCII, so no byte of a longer code point can be
mistaken for one.  A word's hash is a polynomial over a table of random 64-bit values, then mixed; equal
words have equal hashes and, up to 64-bit chance, only they do.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)
#: White space of the word contracts: 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False


def trim() -> None:
    """Give freed memory back: Python workers outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """A partition function for mapInArrow that trims when it is done."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        base = np.full(size, _P if which == "p" else _PINV, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size <= 1 << 24:  # a longer text's powers are not kept
            _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of texts lo..hi-1 of a batch; bounds[i]:bounds[i+1] are those of text lo+i."""

    lo: int
    hi: int
    data: np.ndarray  # folded bytes
    offsets: np.ndarray  # byte offsets of the texts in data
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.bounds))

    def prefixes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of each word's first so many bytes; 0 for words that aren't longer."""
        n = len(self.data)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("p", n), out=run[1:])
        back = _power("i", n)[self.start] if n else np.zeros(0, np.uint64)
        out = []
        for k in sizes:
            end = np.minimum(self.start + k, self.end)
            h = mix((run[end] - run[self.start]) * back + U(k))
            h[self.end - self.start <= k] = 0
            out.append(h)
        return out


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def spans(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs lo..hi of texts of at most `most` bytes together; a longer text stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(array: pa.Array, sep: np.ndarray = SPACES, fold: np.ndarray = FOLD, latin: bool = False) -> Iterator[Words]:
    """Words of each run of texts; A-Z are folded, with `latin` also the capitals from U+00C0 to U+00DE."""
    data, off = buffers(array)
    folded, inner = fold.tobytes(), (~sep).tobytes()
    for lo, hi in spans(off):
        a, b = int(off[lo]), int(off[hi])
        own = off[lo : hi + 1] - a
        chunk = np.frombuffer(bytearray(data[a:b].tobytes().translate(folded)), np.uint8)
        n = b - a
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(lo, hi, chunk, own, none, none, np.zeros(hi - lo + 1, np.int64), none.astype(np.uint64))
            continue
        if latin:  # second bytes after 0xC3, but for the multiplication sign
            at = np.flatnonzero(chunk[:-1] == 0xC3) + 1
            at = at[(chunk[at] >= 0x80) & (chunk[at] <= 0x9E) & (chunk[at] != 0x97)]
            chunk[at] += 0x20
        inside = np.frombuffer(chunk.tobytes().translate(inner), bool)
        edge = np.zeros(n + 1, bool)
        edge[own] = True  # no word runs on into the next text
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        bounds = np.searchsorted(start, own)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[chunk] * _power("p", n), out=run[1:])
        h = mix((run[end] - run[start]) * _power("i", n)[start])
        yield Words(lo, hi, chunk, own, start, end, bounds, h)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (runs across texts included); len(h)-k+1 values."""
    out = h[: max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[i : i + len(out)])
    return out


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; the whole sequence where it has fewer words."""
    every = chain(w.hash, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        n = b - a
        if n >= k:
            s = every[a : b - k + 1].copy()
            s.sort()
            if n > k:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif n:
            out.append(mix(chain(w.hash[a:b], n) + U(n)))
        else:
            out.append(every[:0])
    return out
