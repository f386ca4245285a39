"""Integer vectors: which rows have one, and blocks of them as matrices for Arrow functions.

A block is one row with some thousand vectors as a binary column, so a pass over a table of vectors hands matrices to Python and
joins of blocks pair matrices instead of rows. Blocks are bounded in bytes, whatever the length of a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.scratch import bounded, saved

BLOCK_BYTES = 1 << 19
TASK_BYTES = 64 << 20

BLOCKS = "place long, ids binary, labels binary, numbers binary, vectors binary"

#: integers up to this size are exact as doubles, and so are their sums, in whatever order they are made
EXACT = 1 << 53


def is_whole(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite; null where it is null."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def floored(vector: str, scale: int) -> Column:
    """Components x as integers floor(scale * x), computed in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of integer arrays as a matrix; shorter arrays are filled up with zeros."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def nullable(column: pa.Array) -> np.ndarray:
    """Integers in two columns: whether it is null, and the value (0 for null)."""
    return np.stack([np.asarray(column.is_null()).astype(np.int64), np.asarray(column.fill_null(0)).astype(np.int64)], 1)


def in_blocks(rows: DataFrame, width: int, count: int, name: str, per_block: int | None = None) -> DataFrame:
    """``rows`` (id long, label long, number long, vector array<long>) as a written table of blocks, dealt out evenly to tasks of
    about ``TASK_BYTES``, at least as many as Spark runs at a time and at most one for each block."""
    per_block = max(1, min(per_block or BLOCK_BYTES, BLOCK_BYTES // max(1, 4 * width)))
    files = max(-(-count * width * 4 // TASK_BYTES), min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // per_block)), 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = nullable(batch.column(0)), nullable(batch.column(1))
            numbers = np.asarray(batch.column(2))
            vectors = matrix(batch.column(3), width).astype("<i4")
            for lo in range(0, batch.num_rows, per_block):
                part = slice(lo, lo + per_block)
                row = [int(numbers[lo]), *(x[part].tobytes() for x in (ids, labels, numbers, vectors))]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names)

    names = ["place", "ids", "labels", "numbers", "vectors"]
    dealt = rows.select("id", "label", "number", "vector").repartition(files)
    return saved(bounded(dealt).mapInArrow(packed, BLOCKS), name)


def unpacked(batch: pa.RecordBatch, k: int, width: int, prefix: str = "") -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row ``k`` of a batch with a block's columns: (place, ids, labels, numbers, vectors)."""
    at = lambda name: batch.column(prefix + name)[k]
    read = lambda name, kind: np.frombuffer(at(name).as_buffer(), kind)
    ids = read("ids", np.int64).reshape(-1, 2)
    return at("place").as_py(), ids, read("labels", np.int64).reshape(-1, 2), read("numbers", np.int64), read("vectors", "<i4").reshape(len(ids), width)
