"""Columns of vectors as numpy matrices.

A vector is usable if it is there and all its components are finite numbers. A
vector that is shorter than the table's longest counts as one with zeros at its
end. A table whose longest vector has more than ``MAX_WIDTH`` components is an
error, since what is broadcast grows with the width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WIDTH = 8192
#: Integer components beyond this count as this (a component of 262,144 at a scale of 256), so that products of two rows fit in 64 bits.
LIMIT = 1 << 26


def usable(vector: Column) -> Column:
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def longest(rows: DataFrame, col: str, *more: Column) -> tuple:
    """The greatest number of components in ``col`` (0 for an empty table), and further aggregates of the same pass."""
    got = tuple(rows.agg(F.coalesce(F.max(F.size(col)), F.lit(0)), *more).first())
    if got[0] > MAX_WIDTH:
        raise ValueError(f"a vector of {got[0]} components; at most {MAX_WIDTH} are taken")
    return got


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a column of lists (none null) as a matrix of doubles."""
    off = column.offsets.to_numpy().astype(np.int64)
    size, flat = np.diff(off), column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers within LIMIT."""
    return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def add_up(matrices: DataFrame, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum of a column of binary arrays of one shape: summed in 64 tasks, those in 8, and the eight on the driver."""

    def add(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    for tasks in (64, 8):
        matrices = matrices.repartition(tasks).mapInArrow(add, "m binary")
    total = np.zeros(shape, kind)
    for r in matrices.collect():
        total += np.frombuffer(r[0], kind).reshape(shape)
    return total
