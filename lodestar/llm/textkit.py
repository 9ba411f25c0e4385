"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on the raw UTF-8 buffer of a whole column chunk: no
Python string is built per word.  Words are maximal runs outside
``[\\x20\\x09-\\x0D]``; ASCII capitals are folded to lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestar.runtime import steady_memory

CHUNK_BYTES = 1 << 20
_U = np.uint64
steady_memory()


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def _byte_table() -> np.ndarray:
    """One well-mixed odd 64-bit value per byte; capitals share their small letter's."""
    t = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    t[65:91] = t[97:123]
    return t


_TABLE = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = np.array([pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(16)], dtype=_U)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row, with the total at the end)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * _power_table(_BASE, len(data)), out=total[1:])
    h = (total[last + 1] - total[first]) * _power_table(_BACK, len(data))[first]
    h += (last - first).astype(_U) * _STEP[7]
    return _mix(h), np.searchsorted(first, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in text order, first shingle of every row, with the total at the end).

    A row with fewer than ``width`` words but at least one has its whole
    sequence as its single shingle; a row without words has none.
    """
    words, at = word_hashes(data, offsets)
    n_words = np.diff(at)
    if not len(words):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    n_full = len(words) - width + 1
    full = np.zeros(len(words), _U)
    if n_full > 0:
        for i in range(width):
            full[:n_full] += words[i : i + n_full] * _STEP[i]
    keep = np.zeros(len(words), bool)
    long_rows = np.flatnonzero(n_words >= width)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[long_rows], 1)
    np.add.at(edge, at[long_rows + 1] - width + 1, -1)
    keep |= np.cumsum(edge[:-1]) > 0
    for row in np.flatnonzero((n_words > 0) & (n_words < width)):
        start, k = int(at[row]), int(n_words[row])
        full[start] = np.append(words[start : start + k] * _STEP[:k], np.full(k, _STEP[9])).sum(dtype=_U)
        keep[start] = True
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    return _mix(full[keep]), np.concatenate([[0], np.cumsum(counts)])


def sorted_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, as (values, row starts)."""
    out, sizes = [], np.zeros(len(at), np.int64)
    for row in range(len(at) - 1):
        own = np.sort(hashes[at[row] : at[row + 1]])
        if len(own) > 1:
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        out.append(own)
        sizes[row + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.cumsum(sizes)
