"""Vectorised scans over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09 to 0x0D), with A-Z lower-cased. Every word gets a
64-bit polynomial hash taken from prefix sums, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the memory of the 64-bit work arrays. A longer text is handled alone, in pieces of this size.
BLOCK_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an unsigned 64-bit array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(_LOWER.astype(np.uint64) + np.uint64(1))


def _power_table(base: int) -> np.ndarray:
    """The powers of ``base`` for the places of a piece."""
    if base not in _powers:
        with np.errstate(over="ignore"):
            steps = np.full(BLOCK_BYTES + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, most_rows: int = 16384) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about BLOCK_BYTES bytes."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, rows)
        yield start, end - start, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def _piece(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomial hash, start, length) of the words of a piece; ``cuts`` are places inside it where rows start."""
    space = _SPACE[raw]
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1]
    ends = inside
    ends[:-1] &= space[1:]
    starts[cuts] |= ~space[cuts]
    ends[cuts - 1] |= ~space[cuts - 1]
    first = np.flatnonzero(starts)
    length = np.flatnonzero(ends) + 1 - first
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[raw] * _power_table(_MULTIPLIER)[: len(raw)], out=sums[1:])
        return (sums[first + length] - sums[first]) * _power_table(_INVERSE)[first], first, length


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, row) of every word of a block. A word never crosses rows.

    A long text is scanned piece by piece, and the hash of a word that pieces cut is put together from its parts, so that
    beyond the results (24 bytes for a word) memory doesn't grow with the text or the word."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(raw), BLOCK_BYTES):
        cuts = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, min(low + BLOCK_BYTES, len(raw)))] - low
        value, first, length = _piece(raw[low : low + BLOCK_BYTES], cuts)
        first = first + low
        if found and len(first) and first[0] == low and low not in offsets[np.searchsorted(offsets, low) :][:1]:
            last_value, last_first, last_length = found[-1]
            if last_first[-1] + last_length[-1] == low:  # the word goes on
                factor = np.uint64(pow(_MULTIPLIER, int(last_length[-1]), 1 << 64))
                with np.errstate(over="ignore"):
                    last_value[-1:] += value[:1] * factor
                last_length[-1] += length[0]
                value, first, length = value[1:], first[1:], length[1:]
        if len(first):
            found.append((value, first, length))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    value, first, length = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
    with np.errstate(over="ignore"):
        value = mix(value + length.astype(np.uint64))
    return value, first, np.searchsorted(offsets, first, side="right") - 1
