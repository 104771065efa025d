"""A whole feed: its tables loaded, checked and counted under the policy of required and optional tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.registry import TableSpec, file_name, tables
from feedspark.sources.archive import FeedError, FeedStore
from feedspark.sources.csvio import ERRORS, check_counts, read_table, spark_type, to_csv_lines, valid, write_table
from feedspark.sources.scratch import scratch

#: Bytes of an archive that are copied at once.
CHUNK = 1 << 16


@dataclass
class Feed:
    """tables: every declared table, None where it is left out; problems: why; counts: rows of the tables that are there."""

    tables: dict[str, DataFrame | None]
    problems: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def register(self, prefix: str = "") -> None:
        """A temporary view of every table that is there."""
        for name, df in self.tables.items():
            if df is not None:
                df.createOrReplaceTempView(f"{prefix}{name}")

    def rows(self, name: str) -> Iterator:
        """Rows of a table, one after the other, without holding it whole."""
        df = self.tables[name]
        return iter(()) if df is None else df.toLocalIterator()


def count_report(checked: dict[str, DataFrame], specs: dict[str, TableSpec]) -> DataFrame:
    """(table_name, required, valid, invalid) for each checked table: all are counted in one job, by partial aggregation."""
    parts = [check_counts(df).select(F.lit(n).alias("table_name"), F.lit(specs[n].required).alias("required"), "valid", "invalid") for n, df in checked.items()]
    return reduce(DataFrame.unionByName, parts)


def read_feed(spark: SparkSession, staged: FeedStore, specs: dict[str, TableSpec] | None = None, multi_line: bool = False) -> dict[str, DataFrame]:
    """The tables that the feed has, each with its errors column, none of them read yet."""
    return {n: read_table(spark, p, s, multi_line) for n, s in (specs or tables()).items() if (p := staged.path(n)) is not None}


def load_feed(spark: SparkSession, staged: FeedStore, quarantine: bool = False, multi_line: bool = False) -> Feed:
    """All tables of a feed, checked.

    A required table that is missing or has a row with errors is a :class:`FeedError`; an optional one is left
    out, with the reason in ``problems``. With ``quarantine``, rows with errors are left out instead, and ``problems``
    says how many; get them with :func:`rejected`.
    """
    specs = tables()
    checked = read_feed(spark, staged, specs, multi_line)
    report = {r.table_name: r for r in count_report(checked, specs).collect()} if checked else {}
    feed = Feed({})
    for name, spec in specs.items():
        row = report.get(name)
        problem = "missing" if row is None else f"{row.invalid} of {row.valid + row.invalid} rows have errors" if row.invalid else None
        if problem and spec.required and (row is None or not quarantine):
            raise FeedError(f"required table {name}: {problem}")
        if problem:
            feed.problems[name] = problem
        there = row is not None and (quarantine or not row.invalid)
        feed.tables[name] = valid(checked[name]) if there else None
        if there:
            feed.counts[name] = row.valid
    return feed


def rejected(checked: dict[str, DataFrame]) -> DataFrame:
    """(table_name, error, n): what is wrong in all tables, counted."""
    parts = [df.select(F.lit(n).alias("table_name"), F.explode(ERRORS).alias("error")) for n, df in checked.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "error").agg(F.count(F.lit(1)).alias("n"))


def export_feed(feed: Feed, folder: str) -> None:
    """Every table that is there as a folder of CSV files with its header."""
    for name, df in feed.tables.items():
        if df is not None:
            write_table(df, f"{folder}/{name}.csv")


def export_archive(spark: SparkSession, frames: dict[str, DataFrame], path: str) -> None:
    """One ZIP archive with a CSV member for each table.

    Tasks write the lines to the shared folder. A ZIP is written from front to back, so the files' bytes then stream through Hadoop's file systems in the driver's
    JVM into the archive, as they do in :func:`stage_archive`; no row comes to the driver. :func:`export_feed` is the form that is written in parallel.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = jvm.java.util.zip.ZipOutputStream(to.getFileSystem(conf).create(to, True))
    try:
        for name, df in frames.items():
            lines = jvm.org.apache.hadoop.fs.Path(scratch(spark, f"lines_{name}"))
            fs = lines.getFileSystem(conf)
            to_csv_lines(df).write.options(compression="none", lineSep="\n").text(lines.toString())
            out.putNextEntry(jvm.java.util.zip.ZipEntry(file_name(name)))
            out.write((",".join(df.columns) + "\n").encode())
            # In order of their names, which is that of the partitions.
            for part in sorted(s.getPath().toString() for s in fs.listStatus(lines) if s.getPath().getName().startswith("part-")):
                rows = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, CHUNK, False)
                finally:
                    rows.close()
            out.closeEntry()
            fs.delete(lines, True)
    finally:
        out.close()


def simple_route(rows: DataFrame, agency_id: str = "agency_id", short_name: str = "short_name") -> DataFrame:
    """Rows of ``routes`` with the defaults of a simple bus route: a new id each, fixed colours, no continuous pick-up or drop-off."""
    # The defaults of a simple route.
    fixed = {"route_type": 3, "route_color": "FFFFFF", "route_text_color": "BBBBBB", "continuous_pickup": 1, "continuous_drop_off": 1}
    own = {"route_id": F.expr("uuid()"), "agency_id": F.col(agency_id), "route_short_name": F.col(short_name)} | {k: F.lit(v) for k, v in fixed.items()}
    return rows.select(*[own.get(c.name, F.lit(None)).cast(spark_type(c)).alias(c.name) for c in tables()["routes"].columns])
