"""What the operators of this subpackage share: tables, batches, written tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.sources.scratch import scratch, ship

#: Rows and bytes of a batch that goes to Python at once.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20
#: Rows that Spark decodes at once from Parquet; rows hold whole texts.
READ_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounded batches for Python, and this package on every executor.

    The settings stay: frames are lazy, and their batches must be bounded when they are read, too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    ship(spark)
    return spark


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives memory that it no longer needs back to the system: workers outlive their tasks."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return bounded


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: lineage is cut, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where a written table has at most ``rows`` rows; Spark chooses the join otherwise."""
    return F.broadcast(df) if df.count() <= rows else df
