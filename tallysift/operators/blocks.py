"""Rows packed as matrices, and passes over them that add up small arrays.

Iterative fits scan the same numbers again and again. Packed once, a scan hands whole float matrices to numpy without
converting rows. A pass returns one array of fixed size, whatever the number of rows: each task sends one, and where
there are many tasks their arrays are added up in groups before the driver sees any.

Stored blocks lie on disk and are streamed one by one. Kept in memory as a table they fill an executor's heap, and Arrow
hands a task 64 MB of them at once.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and the bytes that wide rows may take in one.
BLOCK_ROWS, BLOCK_BYTES = 8192, 1 << 19
#: Arrays of at most so many tasks are sent to the driver as they are.
DIRECT = 64


def pack(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of rows as (block: float64 matrix, nulls: rows left out because one of the columns is null)."""
    count = len(columns)
    rows = _block_rows(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                known = np.ones(len(part), bool)
                for k in range(count):
                    known &= part.column(k).is_valid().to_numpy(zero_copy_only=False)
                values = np.empty((int(known.sum()), count))
                for k in range(count):
                    values[:, k] = part.column(k).to_numpy(zero_copy_only=False)[known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([values.tobytes()], pa.binary()), pa.array([len(part) - len(values)], pa.int64())],
                    names=["block", "nulls"])

    doubles = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)))
    return doubles.mapInArrow(run, "block binary, nulls long")


def pack_arrays(df: DataFrame, column: str, size: int) -> DataFrame:
    """The same for an array column; arrays of another length or with a null in them are left out."""
    values = F.col(column).cast("array<double>")
    good = F.coalesce((F.size(values) == size) & ~F.exists(values, lambda v: v.isNull()), F.lit(False))
    rows = _block_rows(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.column(0).slice(at, rows)
                known = part.drop_null()
                flat = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([flat.tobytes()], pa.binary()), pa.array([len(part) - len(known)], pa.int64())],
                    names=["block", "nulls"])

    return df.select(F.when(good, values).alias("v")).mapInArrow(run, "block binary, nulls long")


def _block_rows(columns: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, columns))))


def persist_blocks(df: DataFrame, pack_up: Callable[[DataFrame], DataFrame]) -> RDD:
    """The blocks of ``pack_up(df)`` as bytes, stored; the caller unpersists.

    The table is evaluated once and packed as it is read, no row is held in memory. If it came in fewer partitions than
    there are cores, its blocks are dealt out to all of them.
    """
    blocks = stored(pack_up(df).select("block").rdd.map(lambda r: bytes(r[0])))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if blocks.getNumPartitions() >= cores:
        return blocks
    numbered = blocks.mapPartitionsWithIndex(lambda p, raws: ((p + k, raw) for k, raw in enumerate(raws)))
    spread = stored(numbered.partitionBy(cores, int).values())
    blocks.unpersist()
    return spread


def stored(blocks: RDD) -> RDD:
    """Blocks written to the executors' disks, at once."""
    blocks = blocks.persist(StorageLevel.DISK_ONLY)
    blocks.count()
    return blocks


def is_packed(samples: DataFrame | RDD) -> bool:
    return isinstance(samples, RDD) or samples.columns == ["block", "nulls"]


def matrices(batch: pa.RecordBatch, columns: int) -> Iterator[np.ndarray]:
    """The matrices of an Arrow batch of blocks."""
    for raw in batch.column(0):
        yield np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, columns)


def mapped(blocks: DataFrame | RDD, columns: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame | RDD:
    """Blocks of ``step(matrix)``, which keeps the rows; matrices have ``columns`` columns."""
    if isinstance(blocks, RDD):
        return blocks.map(lambda raw: step(np.frombuffer(raw, np.float64).reshape(-1, columns)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([step(values).tobytes() for values in matrices(batch, columns)], pa.binary()), batch.column(1)],
                names=["block", "nulls"])

    return blocks.mapInArrow(run, "block binary, nulls long")


def add_up(blocks: DataFrame | RDD, columns: int, size: int, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``step(matrix)``, an array of ``size`` doubles; matrices have ``columns`` columns."""
    def run(raws: Iterable) -> Iterator[bytes]:
        total = np.zeros(size)
        for raw in raws:
            values = np.frombuffer(raw, np.float64).reshape(-1, columns)
            if len(values):
                total += step(values)
        yield total.tobytes()

    def fold(raws: Iterable) -> Iterator[bytes]:
        total = np.zeros(size)
        for raw in raws:
            total += np.frombuffer(raw, np.float64)
        yield total.tobytes()

    if isinstance(blocks, RDD):
        each, parts, tasks = RDD.mapPartitions, blocks, blocks.getNumPartitions()
    else:
        each, parts, tasks = _each, blocks.select("block"), blocks.rdd.getNumPartitions()
    parts = each(parts, run)
    while tasks > DIRECT:
        tasks = max(DIRECT, int(tasks ** 0.5))
        parts = each(parts.repartition(tasks), fold)
    total = np.zeros(size)
    for r in parts.collect():
        total += np.frombuffer(r if isinstance(blocks, RDD) else bytes(r["total"]), np.float64)
    return total


def _each(parts: DataFrame, f: Callable[[Iterable], Iterator[bytes]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for total in f(raw.as_buffer() for batch in batches for raw in batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], names=["total"])

    return parts.mapInArrow(run, "total binary")
