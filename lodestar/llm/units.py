"""Encoding whole columns of text by way of their distinct units.

A *unit* is a run of white space with the run of other characters behind it.
Tokenizers whose pieces never reach across a "solid, then white" border can
encode each unit by itself, so a column chunk needs one call per distinct
unit; all else is array work on the raw UTF-8 buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestar.llm.textkit import _BACK, _BASE, _STEP, _U, _mix, _power_table, chunks, string_buffers

# One value per byte; unlike the word hash, capitals differ from small letters.
_EXACT = _mix(np.arange(7, 263, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
MAX_CACHED_UNITS = 500_000


def unicode_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a character with the Unicode property White_Space."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    mask = space[data]
    if len(data) > 1 and (at := np.flatnonzero(data[:-1] == 0xC2)).size:
        at = at[np.isin(data[at + 1], (0x85, 0xA0))]
        mask[at] = mask[at + 1] = True
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    if lead.size:
        code = (data[lead].astype(np.int64) - 0xE0 << 12) | (data[lead + 1].astype(np.int64) & 63) << 6 | (data[lead + 2].astype(np.int64) & 63)
        wide = (code == 0x1680) | ((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
        for i in range(3):
            mask[lead[wide] + i] = True
    return mask


def blank_only(data: np.ndarray) -> np.ndarray:
    """Which bytes are U+0020."""
    return data == 0x20


class HashIndex:
    """64-bit keys with an int32 code each: open addressing, looked up and filled in whole arrays."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.keys, self.codes, self.n = np.zeros(1 << bits, _U), np.full(1 << bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, -1 where there is none."""
        slot = (keys & _U(self.mask)).astype(np.int64)
        out = self.codes[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.codes[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give new distinct keys the next codes, in order."""
        slot = (keys & _U(self.mask)).astype(np.int64)
        left = np.arange(len(keys))
        while left.size:
            free = left[self.codes[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]] = keys[put]
            self.codes[slot[put]] = self.n + put
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.n += len(keys)


class UnitEncoder:
    """Ids of whole texts, built from the ids of their distinct units.

    ``encode(units, first)`` gets distinct units (bytes, and whether each
    opens its text) and returns a list of ids for each; ``split`` may name
    further borders at which the tokenizer always cuts.  The cache never holds
    more than ``MAX_CACHED_UNITS`` and is kept between the tasks of a worker; a
    chunk with more units passes it in slices.
    """

    def __init__(self, encode: Callable[[list[bytes], list[bool]], list[list[int]]], white: Callable[[np.ndarray], np.ndarray], mark_first: bool = False, split: Callable[[np.ndarray], np.ndarray] | None = None):
        self.encode, self.white, self.mark_first, self.split = encode, white, mark_first, split
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(MAX_CACHED_UNITS.bit_length() + 1)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, hashes: np.ndarray, units: list[bytes], first: list[bool]) -> None:
        ids = self.encode(units, first)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        n = self.index.n
        while n + len(ids) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(ids)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(ids)] = lens
        self.index.add(hashes)
        self.used += len(flat)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row starts with the total at the end) of one chunk of rows."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        white = self.white(data)
        opens = white.copy()
        opens[1:] &= ~white[:-1]
        if self.split is not None:
            opens |= self.split(data)
        row_first = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[row_first] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(data))
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_EXACT[data] * _power_table(_BASE, len(data)), out=total[1:])
        h = (total[end] - total[begin]) * _power_table(_BACK, len(data))[begin] + (end - begin).astype(_U) * _STEP[3]
        leads = np.zeros(len(begin), bool)
        leads[np.searchsorted(begin, row_first)] = True
        if self.mark_first:
            h[leads] += _STEP[5]
        h = _mix(h)
        raw = data.tobytes()
        lens, parts = np.zeros(len(begin), np.int64), []
        step = MAX_CACHED_UNITS // 4
        for a in range(0, len(begin), step):
            own = slice(a, a + step)
            code = self._codes(h[own], raw, begin[own], end[own], leads[own])
            lens[own] = self.lens[code]
            stop = np.cumsum(lens[own])
            parts.append(self.flat[np.repeat(self.starts[code] - (stop - lens[own]), lens[own]) + np.arange(stop[-1])])
        before = np.concatenate([[0], np.cumsum(lens)])
        return parts[0] if len(parts) == 1 else np.concatenate(parts), before[np.searchsorted(begin, offsets)]

    def _codes(self, h: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """The cache's code of each unit of a slice, good until the next call."""
        code = self.index.find(h)
        new = np.flatnonzero(code < 0)
        if not len(new):
            return code
        fresh, at = np.unique(h[new], return_index=True)
        if self.index.n + len(fresh) > MAX_CACHED_UNITS:
            self._clear()
            new = np.arange(len(h))
            fresh, at = np.unique(h, return_index=True)
        spots = new[at]
        self._learn(fresh, [raw[a:b] for a, b in zip(begin[spots].tolist(), end[spots].tolist(), strict=True)], leads[spots].tolist())
        code[new] = self.index.find(h[new])
        return code

    def batches(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, row starts) for the chunks of a column; null is empty."""
        data, offsets = string_buffers(column)
        for a, b in chunks(offsets):
            yield a, b, *self.chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
