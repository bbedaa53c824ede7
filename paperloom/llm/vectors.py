"""Integer vectors in columnar NumPy blocks, and sums over them through a reduction tree.

A block is one row of a written table: up to BLOCK_BYTES of vectors of one length,
component by component. Kernels see blocks as (length, rows) arrays, so a step over a
component is a step over contiguous memory, and a lost executor repeats its blocks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

#: Bytes of a block's components, and its vectors at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192
#: Components within this bound are squared and summed in 64 bits; beyond it Python's integers are used.
NARROW = 1 << 26


def whole(embedding: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~bad, F.lit(False))


def scaled(embedding: str, by: float = 256.0) -> Column:
    """floor(by * component) of each component in double precision, as long; what a long cannot hold is its nearest long."""
    top = float((1 << 63) - 1024)

    def at(x: Column) -> Column:
        v = x.cast("double") * F.lit(by)
        return F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), v)))

    return F.transform(embedding, at)


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, (rows, length) array) for each length among a list column's rows."""
    lists = pa.concat_arrays([lists])
    lengths, flat = np.asarray(pc.list_value_length(lists)), np.asarray(lists.flatten())
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == d)
        yield d, mine, flat[first[mine][:, None] + np.arange(d)]


def blocks(rows: DataFrame, x: str, scratch: Scratch) -> DataFrame:
    """dim, size, data: a written table of the blocks of an array<long> column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, mine, v in by_length(batch.column(0)):
                step = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(d, 1))))
                for lo in range(0, len(mine), step):
                    part = v[lo : lo + step]
                    yield pa.record_batch(
                        [pa.array([d], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([np.ascontiguousarray(part.T).tobytes()], pa.binary())], names=["dim", "size", "data"])

    return scratch.store(rows.select(x).mapInArrow(lean(run), "dim int, size long, data binary"), "blocks")


def columns(data: bytes, dim: int, size: int) -> np.ndarray:
    """A block's (dim, size) array; of Python integers if 64 bits could overflow in squares."""
    x = np.frombuffer(data, np.int64).reshape(dim, size)
    wide = x.size and (x.max() > NARROW or x.min() < -NARROW)
    return x.astype(object) if wide else x


def tree_sum(stored: DataFrame, part: Callable[[int, np.ndarray], object]) -> dict:
    """{length: sum of part(length, block) over all blocks}, added in tasks and then through a tree of tasks.

    part returns a tuple of arrays; only the tree's last few sums reach the driver.
    """

    def add(total: dict, r) -> dict:
        return merge(total, {r[0]: part(r[0], columns(bytes(r[2]), r[0], r[1]))})

    def merge(a: dict, b: dict) -> dict:
        for d, sums in b.items():
            a[d] = tuple(p + q for p, q in zip(a[d], sums, strict=True)) if d in a else sums
        return a

    return stored.select("dim", "size", "data").rdd.treeAggregate({}, add, merge)
