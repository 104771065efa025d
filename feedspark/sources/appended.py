"""A table that rows are appended to, read back in the order in which they came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.sources.scratch import scratch


class AppendedTable:
    """Batches of rows of one schema, each a partition of a Parquet table; a batch that fails half-way leaves no rows.

    Rows have (_batch, _row): a batch's number, and a number that grows along the batch's own order of rows.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None) -> None:
        self.spark, self.path, self.batches = spark, path or scratch(spark, "appended"), 0
        self.empty = spark.createDataFrame([], schema)

    def append(self, rows: DataFrame) -> None:
        """Add rows, by column name."""
        ordered = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.empty.schema.fields], F.monotonically_increasing_id().alias("_row"))
        ordered.write.parquet(f"{self.path}/_batch={self.batches}")
        self.batches += 1

    def rows(self) -> DataFrame:
        """All rows so far with _batch and _row, in no set order; sort by both for the order in which they came."""
        if not self.batches:
            return self.empty.withColumns({"_row": F.lit(0).cast("bigint"), "_batch": F.lit(0)})
        stored = self.empty.withColumn("_row", F.lit(0).cast("bigint")).withColumn("_batch", F.lit(0)).schema
        return self.spark.read.schema(stored).parquet(self.path)

    def in_order(self) -> DataFrame:
        """All rows in the order in which they came, by one range-partitioned sort."""
        return self.rows().orderBy("_batch", "_row").drop("_batch", "_row")
