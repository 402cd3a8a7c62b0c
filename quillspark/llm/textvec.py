"""Vectorised work on the bytes of many texts at once (numpy, no per-word Python)."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x51D7348D))
#: One random odd 64-bit weight per byte value.
BYTE_WEIGHT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(kind: str, n: int) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2**64."""
    have = _POWERS[kind]
    if len(have) < n:
        have = np.full(max(n, 1 << 20), BASE if kind == "up" else BASE_INVERSE, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 21:  # at most 16 MiB stay
            _POWERS[kind] = have
    return have[:n]


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset:]
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P[i]: weighted polynomial of the first i bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(BYTE_WEIGHT[data], powers("up", len(data)), out=out[1:])
    np.cumsum(out, out=out)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes give equal values wherever they stand."""
    h = prefix[end] - prefix[start]
    h *= powers("down", len(prefix))[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each row."""
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(data):
        edge[0], edge[-1] = word[0], word[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts)
    both = cuts[word[cuts] & word[cuts - 1]] if len(cuts) else cuts
    at = np.flatnonzero(edge)
    if len(both):  # a word that ends where a row ends and the next row starts with one
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[::2], at[1::2]
    return start, end, np.searchsorted(start, offsets)


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch with about ``most`` bytes of ``column`` (one row at least)."""
    size = batch.column(column)
    if not len(size):
        return
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.binary_length(size), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at, total = [], 0, 0
    for i, n in enumerate(lens):
        if total and total + n > most:
            ends.append(i)
            total = 0
        total += n
    for end in [*ends, len(lens)]:
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Give freed memory back to the system: Spark keeps a worker for other stages,
    and Arrow and malloc would keep the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


def releasing(run):
    """``run``, a function for mapInArrow, with ``release`` at the end of a partition."""

    def then_release(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return then_release
