"""Grouped work on sorted Arrow batches, without gathering a group of unknown size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches in which every run of equal values of the first (integer) column is whole.

    With `most`, a run is given out in parts once that many of its rows are held.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[0].as_py() == key[-1]:
            held.append(b)
        else:
            last = int(np.searchsorted(key, key[-1]))
            if last:
                held.append(b.slice(0, last))
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b.slice(last)]
        if most is not None and sum(map(len, held)) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def run_bounds(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)


def binaries(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed arrays, concatenated, and how many each row has; null has none."""
    parts = [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def as_binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """values[edge[k]:edge[k + 1]] as binary values."""
    offsets = (np.asarray(edge) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
