"""Vectors in blocks: what both vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """(uid, vec_id, v) of the vectors that take part, one row a row.

    Left out: null ids and vectors, null or non-finite components, and zero
    vectors (empty ones too) unless ``zero``.  ``uid`` tells rows apart where
    they repeat a vec_id."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return materialize(rows.where("size(v) > 0").withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "v"), "vectors")


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The rows of each vector length, as only equally long vectors have a product."""
    lengths = sorted(r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    return [rows] if len(lengths) == 1 else [rows.where(F.size("v") == d) for d in lengths]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those with the least hash of their id."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(most).select("v")
    return matrix(picked.toArrow()["v"])


def meet(pairs: DataFrame, queries: DataFrame, data: DataFrame, n_data: int) -> DataFrame:
    """Blocks that meet: ``pairs`` (qb, db) with the columns of both.

    Query blocks travel, data blocks go to their own partition once.  The
    partitions are numbered by hand, so that they aren't merged by their size."""
    parts = min(4 * max(1, n_data), 1 << 16)
    left = pairs.join(queries, "qb").repartition(parts, "db")
    return left.join(data.repartition(parts, "db").hint("shuffle_merge"), "db")


def every_pair(n_queries: int, n_data: int, spark) -> DataFrame:
    """(qb, db) for all blocks, both counted from 0."""
    return spark.range(n_queries).select(F.col("id").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))).alias("db"))


def best_of_blocks(found: DataFrame, k: int) -> DataFrame:
    """The k best (score, then smaller vec_id) of each query row over all blocks."""
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_row(compute: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that handles one row (a pair of blocks) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield compute(batch.slice(i, 1).to_pylist()[0])

    return run
