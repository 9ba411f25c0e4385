"""Fixed-size arrays of counters over hashed keys, filled by all tasks and summed by range.

What reaches the driver and goes to every task is bounded by the number of
slots: a bit for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.textkit import _STEP, _U, _mix
from lodestar.runtime import freed_shuffles, ship

RANGE = 1 << 14


def partial_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(range, packed) columns of a task's counters: compressed byte planes of each range that has any."""
    table = counts.astype(np.uint32, copy=False).reshape(-1, RANGE)
    where = np.flatnonzero(table.any(axis=1))
    packed = [zlib.compress(np.ascontiguousarray(table[i].view(np.uint8).reshape(RANGE, 4).T).tobytes(), 1) for i in where.tolist()]
    return pa.array(where, pa.int32()), pa.array(packed, pa.binary())


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, RANGE).T).view(np.uint32).ravel()


def flags_over(parts: DataFrame, slots: int, threshold: int) -> np.ndarray:
    """One boolean for each slot: whether all tasks' counts together are ``threshold`` or more.

    ``parts(range int, packed binary)``; sums are streamed range by range, and
    a row of ``RANGE`` bits for each range comes to the driver.
    """
    ship(parts.sparkSession)
    ranges = slots // RANGE

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for where, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(where, np.zeros(RANGE, np.int64))[:] += _unpack(packed.as_py())
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([np.packbits(sums[x] >= threshold).tobytes() for x in names], pa.binary())], ["range", "bits"])

    out = np.zeros((ranges, RANGE), bool)
    with freed_shuffles(parts.sparkSession):
        rows = parts.select("range", "packed").repartition(max(1, min(ranges, 64)), "range").mapInArrow(total, "range int, bits binary").collect()
    for row in rows:
        out[row["range"]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    return out.ravel()


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """Where a Bloom filter of ``bits`` bits (a power of two) has the bits of 64-bit ids: a row for each of three hashes."""
    h = _mix(ids.astype(np.int64, copy=False).view(_U) ^ _STEP[1])
    return np.stack([(_mix(h + _STEP[i]) & _U(bits - 1)).astype(np.int64) for i in (2, 6, 10)])


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter, as packed bits, of the ids in the only column of ``ids``."""
    ship(ids.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(id_slots(batch.column(0).to_numpy(), bits))
            where = at // RANGE
            for own in np.split(at, np.flatnonzero(where[1:] != where[:-1]) + 1):
                if len(own):
                    counts = np.zeros(RANGE, np.uint32)
                    counts[own % RANGE] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([int(own[0]) // RANGE], pa.int32()), partial_rows(counts)[1]], ["range", "packed"])

    return np.packbits(flags_over(ids.mapInArrow(mark, "range int, packed binary"), bits, 1))


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter may hold."""
    at = id_slots(ids, 8 * len(packed))
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
