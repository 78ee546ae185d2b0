"""Vectors packed into blocks for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id, embedding: rows with an id and a vector without null or non-finite components.

    The usual length is the commonest one; vectors of another length take no part, nor (unless zero_too) zero vectors.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    x = x.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return x if zero_too else x.filter(F.exists("embedding", lambda v: v != 0))


def dimensions(vectors: DataFrame) -> int:
    found = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def packed(vectors: DataFrame, block: Column, d: int, kind: type = np.float64) -> DataFrame:
    """block, n, ids, data: the vectors of a block as bytes (int64 ids, components of that kind), in ascending order of id."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, data = table.column("vec_id").to_numpy()[order], matrix(table.column("embedding"), d)[order]
        return pa.table({"block": table.column("block")[:1], "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([np.ascontiguousarray(data, kind).tobytes()], pa.binary())})

    return vectors.withColumn("block", block.cast("long")).groupBy("block").applyInArrow(run, "block long, n int, ids binary, data binary")


def unpack(ids: bytes, data: bytes, d: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, d)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}
