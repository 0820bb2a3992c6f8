"""Mini-batches for training: rows shuffled through bounded buffers, and a table with a partition for each batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a task's buffer, and rows that it gives out at once.
BUFFER, CHUNK = 120_000, 2_048


def through_buffer(batches: Iterator[pa.RecordBatch], size: int, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
    """The rows of batches in a random order: a buffer of `size` rows fills; from then on each new row takes the place of one drawn at random, which comes out; the rest follows in random order.

    Rows are replaced a chunk at a time (drawn places differ within it), so at most size + CHUNK rows and one batch are held. A chunk is no larger than the buffer, as each of its rows takes a place there.
    """
    held: pa.Table | None = None
    chunk = max(1, min(CHUNK, size))
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            new = pa.Table.from_batches([batch.slice(at, chunk)])
            held = new if held is None else pa.concat_tables([held, new])
            over = held.num_rows - size
            if over > 0:
                out = rng.choice(held.num_rows - new.num_rows if held.num_rows > new.num_rows else held.num_rows, over, replace=False)
                rest = np.ones(held.num_rows, bool)
                rest[out] = False
                yield from held.take(pa.array(out)).combine_chunks().to_batches()
                held = held.filter(pa.array(rest)).combine_chunks()
    if held is not None and held.num_rows:
        yield from held.take(pa.array(rng.permutation(held.num_rows))).combine_chunks().to_batches()


def shuffled_in_buffers(df: DataFrame, buffer: int = BUFFER, seed: int = 1) -> DataFrame:
    """df with the rows of each task in a random order, as far as a buffer of so many rows mixes them; no shuffle of the table. Each row comes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from through_buffer(batches, buffer, np.random.default_rng([seed, TaskContext.get().partitionId()]))

    return df.mapInArrow(run, df.schema)


def with_batches(df: DataFrame, steps: int, buffer: int = BUFFER, seed: int = 1) -> DataFrame:
    """df, shuffled in buffers, with a column batch (0 .. steps - 1): each task deals its rows round, from a batch drawn at random. So batches differ by at most one row for each task."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        at = int(rng.integers(steps))
        for b in through_buffer(batches, buffer, rng):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at + np.arange(b.num_rows)) % steps, pa.int32())], [*b.schema.names, "batch"])
            at += b.num_rows

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("batch", IntegerType())]))


def write_batches(df: DataFrame, path: str, steps: int, buffer: int = BUFFER, seed: int = 1) -> None:
    """Write with_batches() as a table partitioned by batch: one shuffle, a folder for each step, and a step's scan reads its own folder alone."""
    with_batches(df, steps, buffer, seed).repartition(steps, "batch").write.partitionBy("batch").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The table of write_batches(), for training.train()."""
    return spark.read.parquet(path)


def batch_sizes(df: DataFrame) -> DataFrame:
    """(batch, n) of a table with batches."""
    return df.groupBy("batch").agg(F.count("*").alias("n"))
