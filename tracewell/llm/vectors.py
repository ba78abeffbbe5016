"""Numpy helpers on columns of vectors, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vectors that are worked on at once.
BLOCK_ROWS = 4096


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and components (as doubles) of the vectors with ``dims`` finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    places = np.flatnonzero((pa.compute.list_value_length(column).fill_null(-1)).to_numpy(zero_copy_only=False) == dims)
    flat = column.take(pa.array(places)).flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(places), dims)
    finite = np.isfinite(values).all(axis=1)
    return places[finite], values[finite]


def floored(values: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * component) as long; beyond ``bound`` in size it is an error."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if scaled.size and not np.abs(scaled).max() <= bound:
        raise ValueError(f"a component times {scale} is beyond {bound} in size")
    return scaled.astype(np.int64)


def as_bytes(values: np.ndarray) -> pa.Array:
    """Each row of a matrix of longs as one binary value."""
    data = np.ascontiguousarray(values, "<i8")
    width = data.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def from_bytes(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty((0, dims), np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i8").reshape(len(column), dims)


def blocks(values: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(values), BLOCK_ROWS):
        yield values[at : at + BLOCK_ROWS]


def summed(df: DataFrame, dims: int, work: Callable[[np.ndarray], np.ndarray], cells: int, column: str = "x") -> np.ndarray:
    """The sum over all vectors of what ``work`` gives for a block of them.

    ``cells`` numbers come from each task and as many reach the driver, whatever the
    number of vectors. Within a task the additions are compensated.
    """

    def task(batches):
        total, lost = np.zeros(cells), np.zeros(cells)
        for batch in batches:
            for block in blocks(from_bytes(batch.column(0), dims)):
                add = work(block).ravel() - lost
                upper = total + add
                lost = (upper - total) - add
                total = upper
        yield pa.record_batch([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    parts = df.select(column).mapInArrow(task, "cell int, value double")
    out = np.zeros(cells)
    for cell, value in parts.groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out


def exact_sums(df: DataFrame, dims: int, work: Callable[[np.ndarray], list[int]], column: str = "x") -> dict[int, int]:
    """Like ``summed``, in whole numbers of any size (38 digits)."""

    def task(batches):
        total: list[int] = []
        for batch in batches:
            for block in blocks(from_bytes(batch.column(0), dims)):
                part = work(block)
                total = [a + b for a, b in zip(total or [0] * len(part), part, strict=True)]
        cells = pa.array(range(len(total)), pa.int32())
        yield pa.record_batch([cells, pa.array([str(t) for t in total], pa.string())], names=["cell", "value"])

    parts = df.select(column).mapInArrow(task, "cell int, value string")
    found = parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string")).collect()
    return {cell: int(value) for cell, value in found}


def common_length(df: DataFrame, column: str) -> int:
    """The length of most vectors (the larger of equally frequent ones); 0 without any."""
    sizes = df.select(F.size(F.col(f"`{column}`")).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("rows"))
    best = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return best.n if best else 0
