"""Arrays packed into binary columns, exchanged by hash bucket.

Operators that compare hundreds of hashes a document move them as blobs: a
task sorts its own part of a bucket and sends one row for it, so the exchange
carries few rows, eight bytes a hash, and one task handles one bucket at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """All blobs of a column one after another."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def slices(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column of data[first[i]:first[i+1]]."""
    at = (np.asarray(first, np.int64) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(blob(data))])


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, from its upper bits."""
    return ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
