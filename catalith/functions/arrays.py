"""numpy views of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def one(col) -> pa.Array:
    """A column as one array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def longs(col) -> tuple[np.ndarray, np.ndarray]:
    """An integer or timestamp column as int64, nulls as 0, and where it is null."""
    arr = one(col)
    null = np.asarray(arr.is_null())
    if pa.types.is_timestamp(arr.type):
        arr = arr.cast(pa.timestamp("us", arr.type.tz)).cast(pa.int64())
    return np.asarray(pc.fill_null(arr.cast(pa.int64()), 0)), null


def fixed(col, width: int | None = None) -> np.ndarray:
    """A column of BINARY without nulls, whose values never end in a zero byte, as a fixed-width bytes array."""
    arr = one(col).cast(pa.large_binary())
    n = len(arr)
    if n == 0:
        return np.empty(0, f"S{width or 1}")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    wide = max(int(lengths.max()), width or 1, 1)
    if (lengths == wide).all():
        return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(f"S{wide}")
    out = np.zeros((n, wide), np.uint8)
    mask = np.arange(wide) < lengths[:, None]
    out[mask] = data[offsets[0] : offsets[-1]]
    return out.view(f"S{wide}").ravel()


def same_width(*arrays: np.ndarray) -> list[np.ndarray]:
    """Bytes arrays brought to the greatest of their widths."""
    wide = max(a.dtype.itemsize for a in arrays)
    return [a.astype(f"S{wide}") for a in arrays]


def found_at(sorted_keys: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each probe in sorted_keys by binary search, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(probes), np.int64), np.zeros(len(probes), bool)
    at = np.minimum(np.searchsorted(sorted_keys, probes), len(sorted_keys) - 1)
    return at, sorted_keys[at] == probes
