"""Numpy arrays packed into one binary value per (sender, bucket), so that a shuffle moves few, dense rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    # columns of different lengths: one list each
    batch = pa.RecordBatch.from_arrays([pa.array([a], pa.list_(pa.from_numpy_dtype(a.dtype))) for a in arrays], names=[str(i) for i in range(len(arrays))])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns]


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)
