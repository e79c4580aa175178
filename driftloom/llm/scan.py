"""Words of whole texts as arrays: places in a buffer of bytes and two 64-bit hashes each, without an object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix

#: Bytes that are hashed at a time, and the longest word that the sums below hash; longer ones take xxhash.
SPAN, LONG = 1 << 16, 64
#: About how many bytes of texts are scanned at a time; one longer text is scanned alone.
SLICE = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Sums:
    """Running polynomial sums over at most SPAN bytes and LONG more; a difference of two, scaled back, hashes the bytes between."""

    def __init__(self, base: int, seed: int):
        n = SPAN + LONG + 1
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))).cumprod(dtype=np.uint64)
            self.down = np.concatenate(([np.uint64(1)], np.full(n - 1, inverse, np.uint64))).cumprod(dtype=np.uint64)
        self.of = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.of[b] * self.up[: len(b)], out=sums[1:])
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_sums: list[_Sums] = []


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int = 2) -> np.ndarray:
    """(rows, n) hashes of the byte strings buf[start:end], whose starts increase."""
    if not _sums:
        _sums.extend(_Sums(b, k) for k, b in enumerate(_BASES))
    out = np.empty((rows, len(start)), np.uint64)
    size = np.minimum(end - start, LONG)
    lo = 0
    while lo < len(start):
        at = int(start[lo])
        hi = int(np.searchsorted(start, at + SPAN, "left"))
        b = buf[at : at + SPAN + LONG]
        s = start[lo:hi] - at
        for r in range(rows):
            out[r, lo:hi] = _sums[r](b, s, s + size[lo:hi])
        lo = hi
    for i in np.flatnonzero(end - start > LONG).tolist():
        digest = np.frombuffer(xxhash.xxh3_128_digest(buf[start[i] : end[i]].tobytes()), np.uint64)
        out[:, i] = digest[:rows]
    return out


def slices(batches: Iterator[pa.RecordBatch], at: int, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, edge of each text in them): about `size` bytes (SLICE) at a time, views and no copies."""
    size = size or SLICE
    for b in batches:
        col = b.column(at).cast(pa.large_binary())
        _, places, data = col.buffers()
        n = len(col)
        if not n:
            continue
        edge = np.frombuffer(places, np.int64, n + 1, col.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(int(np.searchsorted(edge, edge[lo] + size, "right")) - 1, lo + 1)
            hi = min(hi, n)
            yield b.slice(lo, hi - lo), raw[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]
            lo = hi


def words(buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number in each text): the words of texts that lie end to end in buf; a word never spans two texts."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    first = inside[1:] & ~inside[:-1]  # at i: a word starts at byte i
    last = inside[:-1] & ~inside[1:]  # at i: a word ends before byte i
    cut = edge[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    joint = cut[inside[cut] & inside[cut + 1]]
    first[joint] = True
    last[joint] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    many = np.diff(np.searchsorted(start, edge))
    return start, end, many


def lower(buf: np.ndarray) -> np.ndarray:
    """buf with A-Z as a-z."""
    return _LOWER[buf]
