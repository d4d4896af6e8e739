"""Vectorised word splitting and hashing over Arrow string columns.

Executors get whole texts as Arrow batches.  The functions here walk their UTF-8
buffers in blocks of about one MiB, so that memory does not follow the batch, and
give each word a 64-bit hash without making a Python string of it.

Hashes: a polynomial over the (lower-cased) bytes modulo 2**64, then a 64-bit
finaliser.  Two different words of one corpus collide with a chance of about
n**2 / 2**65 for n distinct words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that part words: space and \t \n \v \f \r.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[list(SPACES)] = False
#: Digits, a-z and everything outside ASCII (texts are lower-cased first).
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[0x30:0x3A] = True
ALNUM_BYTES[0x61:0x7B] = True
ALNUM_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, kept between calls up to a few blocks."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, BLOCK + (BLOCK >> 2))
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        made.append(p)
    if size <= 4 * BLOCK:
        _powers[:] = made
    return made[0], made[1]


def lean(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives what each batch took back to the system, since idle workers keep their memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield step(batch)
            del batch
            release()

    return run


def release() -> None:
    """Gives unused memory of Arrow and of the C library back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(0x2545F4914F6CDD1D))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with about ``size`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes of ``kind``; runs end with their row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    power, inverse = _upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(column: pa.Array, kind: np.ndarray = WORD_BYTES, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows [a, b): a, b, the hash of each word, and its row less a."""
    data, offsets = utf8(column)
    for a, b in blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        if lower:
            part = LOWER[part]
        starts, ends, row = spans(part, offsets[a : b + 1] - offsets[a], kind)
        yield a, b, hashes(part, starts, ends), row


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, laid out byte by byte."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """Inverse of :func:`pack`."""
    width = blob[0]
    planes = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Like :func:`pack` for ascending numbers: their differences."""
    v = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    """Inverse of :func:`pack_sorted`."""
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(blob), dtype=np.uint64)
