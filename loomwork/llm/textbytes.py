"""Arrow text columns as byte arrays: words, digests and ranges found without a Python loop per word.

Every helper works on a slice of a batch, so memory is bounded by ``SLICE_BYTES`` plus the longest
single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> _S33)
    x *= _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets of the texts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch of about ``limit`` bytes of text, with their bytes and offsets."""
    data, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row), data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_table(pattern_bytes) -> np.ndarray:
    """A table of 256 flags from the byte values that belong to words."""
    table = np.zeros(256, np.bool_)
    table[list(pattern_bytes)] = True
    return table


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (one more entry at the end)."""
    n = len(data)
    inside = np.zeros(n + 1, np.bool_)
    inside[:n] = table[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] |= inside[heads]
    last = inside[:n] & ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] |= inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next slice while they are small."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 2 * SLICE_BYTES + 1:
        _POWERS["up"], _POWERS["down"] = out
    return out[0], out[1]


def range_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each byte range; equal bytes give equal digests wherever they stand."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    digests = (sums[ends] - sums[starts]) * down[starts]
    return mix(digests + (ends - starts).astype(np.uint64))


def gram_digests(digests: np.ndarray, size: int) -> np.ndarray:
    """A digest of each run of ``size`` consecutive entries."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * 0x9E3779B97F4A7C15 + 2 * i + 1 | 1
        total += digests[i : i + n] * np.uint64(factor & (1 << 64) - 1)
    return mix(total)


def runs_to_list(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Consecutive values as one list for each count."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def binary_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``counts`` entries of an array as binary values."""
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    offs *= data.itemsize
    if offs[-1] < 2**31:
        return pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        )
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    return pa.array([bytes(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])], pa.large_binary())


def replace_column(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with further columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
