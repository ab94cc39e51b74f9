"""Numpy kernels over the UTF-8 bytes of an Arrow string column: words, hashes, shingles, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_B = np.arange(256)
#: Whitespace that parts words: space and tab to carriage return.
SPACE = (_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D))
#: ASCII bytes that are neither letter nor digit; bytes of other code points belong to words.
NOT_ALNUM = (_B < 0x80) & ~(((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A)))
#: A-Z to a-z.
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)
_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
#: Bytes that are taken at once within a text, so that tables and scratch arrays don't grow with the longest one.
SEGMENT = 1 << 20
_POWERS: list[np.ndarray] = []


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of int64) of a string column; null becomes empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most limit bytes together (a longer text comes alone): (first, end, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each text); texts never share a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse, up to SEGMENT."""
    if not _POWERS:
        for base in (_R, pow(_R, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.concatenate([np.ones(1, U), np.full(SEGMENT, base, U)])))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands: differences of one running polynomial sum, in segments. Both ascend."""
    up, down = _powers()
    lo, hi = np.zeros(len(starts), U), np.zeros(len(starts), U)
    total, scale, steps = np.zeros(1, U), np.ones(1, U), [np.ones(1, U)]
    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * down[: len(part)], out=sums[1:])
        own = slice(*np.searchsorted(starts, [a, a + len(part)]))
        lo[own] = total + scale * sums[starts[own] - a]
        own = slice(*np.searchsorted(ends, [a, a + len(part)], "right"))
        hi[own] = total + scale * sums[ends[own] - a]
        total, scale = total + scale * sums[-1:], scale * down[-1:]
        steps.append(steps[-1] * up[-1:])
    return mix((hi - lo) * up[starts % SEGMENT] * np.concatenate(steps)[starts // SEGMENT])


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width words of each text, and their offsets; a text of fewer words has its whole sequence as one."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(offsets[-1], U)
    if not len(h):
        return out, offsets

    def run(first: np.ndarray, size: int) -> np.ndarray:
        acc = np.full(len(first), size, U)
        for j in range(size):
            acc = mix(acc * U(0xD6E8FEB86659FD93) + h[first + j])
        return acc

    long = n >= width
    short_slot = np.zeros(len(out), bool)
    short_slot[offsets[:-1][(n > 0) & ~long]] = True
    valid = np.ones(len(h), bool)
    ends = np.repeat(at[1:], n)
    valid[np.arange(len(h)) + width > ends] = False
    out[~short_slot] = run(np.flatnonzero(valid), width)
    for size in range(1, width):
        these = np.flatnonzero(n == size)
        out[offsets[these]] = run(at[these], size)
    return out, offsets


def sum_by(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x (1- or 2-dimensional) between offsets; 0 for empty runs."""
    out = np.zeros((len(at) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, at[full], axis=0)
    return out


def set_keys(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits of each run of distinct values, independent of their order, as binary."""
    n = np.diff(at)
    a = sum_by(mix(values ^ U(0x243F6A8885A308D3)), at) + U(1) * n.astype(U)
    b = sum_by(mix(values ^ U(0x13198A2E03707344)), at)
    flat = np.ascontiguousarray(np.stack([a, b], 1).astype(">u8")).view(np.uint8).ravel()
    return binaries(flat, np.arange(len(n) + 1, dtype=np.int64) * 16)


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def longs(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """list<int64> from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64) if flat.dtype == U else flat.astype(np.int64)))
