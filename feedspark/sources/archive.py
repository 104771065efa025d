"""Feed archives: which member holds which table, and members staged as files that Spark can split."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession

from feedspark.registry import table_of
from feedspark.sources.scratch import scratch

log = logging.getLogger(__name__)


class FeedError(ValueError):
    """A feed that can't be loaded as its tables are declared."""


def add_member(found: dict[str, str], member: str) -> str | None:
    """Note in ``found`` (table to member) the table that a member holds, if any, and tell it; two members for one table are an error."""
    if member.endswith("/"):
        return None
    name = table_of(member)
    if name is None:
        log.warning("unknown member %s is skipped", member)
    elif name in found:
        raise FeedError(f"{found[name]} and {member} both hold the table {name}")
    else:
        found[name] = member
    return name


def catalog(members: list[str]) -> dict[str, str]:
    """Table to member; unknown members are left out, two members for one table are an error."""
    found: dict[str, str] = {}
    for m in members:
        add_member(found, m)
    return found


class FeedStore(Protocol):
    """Where a feed's tables are: anything that names a path (a file, or a folder of files) for each table that it has."""

    def path(self, table: str) -> str | None: ...


@dataclass
class Staged:
    """A feed whose members are files: table to path."""

    spark: SparkSession
    paths: dict[str, str]

    def path(self, table: str) -> str | None:
        return self.paths.get(table)


def stage_archive(spark: SparkSession, path: str, into: str | None = None) -> Staged:
    """Copy the known members of a ZIP archive to the shared folder, each as one file.

    The bytes stream through Hadoop's file systems in the driver's JVM, whatever the archive's place and size, and
    are never held whole: a ZIP can only be read from front to back, but its staged members are split among tasks.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    into = into or scratch(spark, "feed")
    found: dict[str, str] = {}
    zipped = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    staged: dict[str, str] = {}
    try:
        while (entry := zipped.getNextEntry()) is not None:
            name = add_member(found, entry.getName())
            if name is None:
                continue
            staged[name] = f"{into}/{name}.csv"
            to = jvm.org.apache.hadoop.fs.Path(staged[name])
            out = to.getFileSystem(conf).create(to, True)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(zipped, out, 1 << 16, False)
            finally:
                out.close()
    finally:
        zipped.close()
    return Staged(spark, staged)


def open_folder(spark: SparkSession, folder: str) -> Staged:
    """A feed that is already unpacked: a folder with a file, or a folder of files, for each table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(conf).listStatus(at)]
    return Staged(spark, {t: f"{folder.rstrip('/')}/{m}" for t, m in catalog(names).items()})
