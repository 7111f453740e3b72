"""Bitmaps of 64-bit keys as runtime filters: of a size that follows the number of keys up to a bound, merged segment by segment.

A filled bitmap lets more rows through to the exact step behind it, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds in 64-bit cells: 32 KB to 16 MB.
MIN_CELLS, MAX_CELLS, SEGMENT = 1 << 12, 1 << 21, 1 << 12


def cells_for(keys: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, 1 << int(keys // 4).bit_length()))


def _places(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    one = np.uint64(1)
    bits = one << (h >> np.uint64(58)) | one << (h >> np.uint64(52) & np.uint64(63))
    return (h >> np.uint64(24) & np.uint64(cells - 1)).astype(np.int64), bits


def build(keys: DataFrame, cells: int) -> np.ndarray:
    """Bitmap of the one long column of ``keys``; on the driver it takes at most MAX_CELLS * 8 bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.uint64)
        for batch in batches:
            cell, bits = _places(np.asarray(batch.column(0)), cells)
            np.bitwise_or.at(own, cell, bits)
        for k in range(cells // SEGMENT):
            part = own[k * SEGMENT : (k + 1) * SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(bits, np.uint64)
                held[k] = held[k] | part if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros(cells, np.uint64)
    for r in keys.mapInArrow(fill, "segment int, bits binary").repartition("segment").mapInArrow(merge, "segment int, bits binary").toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(bytes(r.bits), np.uint64)
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell, bits = _places(keys, len(bitmap))
    return bitmap[cell] & bits == bits
