"""URL filters as a temporal join: every capture meets the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.llm.shared import small

#: Intervals up to which they are broadcast; beyond, captures and intervals are joined by shuffle.
BROADCAST_ENTRIES = 500_000
#: Kinds of entries from the least to the most specific.
KINDS = ("domain", "host", "prefix")


def host_of(url: Column) -> Column:
    """The host, lower-cased, without user, port and trailing dot; null if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, without query and fragment; / if it is empty."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, pattern, action, valid_from, valid_to) from dated entries.

    entries: list, kind (domain, host or prefix), pattern, action (block or allow), event (add or
    remove), at, seq. An entry counts from its addition until the next event of the same list,
    kind and pattern; of events at one time the last by seq counts. valid_to is null while it lasts.
    Rows with a null list, kind, pattern or time are no entries.
    """
    rows = entries.where("list IS NOT NULL AND kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL")
    rows = rows.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "event", "at", "seq")
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at", "seq", "event", "action")
    rows = rows.withColumn("valid_to", F.lead("at").over(order)).withColumnRenamed("at", "valid_from")
    return rows.where("event = 'add' AND (valid_to IS NULL OR valid_to > valid_from)").select("list", "kind", "pattern", "action", "valid_from", "valid_to")


def _keys(host: Column, path: Column, depth: int) -> Column:
    """What can match a capture: each domain above its host, the host, its whole path, and each prefix of it that ends in one of
    the first ``depth`` slashes; no entry has more, and all prefixes of a path of many slashes would grow with its square."""
    labels, parts = F.split(host, r"\."), F.split(F.lower(path), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")).alias("key")))
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lower(path)).alias("key")))
    return F.array_distinct(F.concat(domains, whole, prefixes))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """What the lists said of each capture at its fetch time.

    Returns ``id_col``, host, fetched_at, n_entries (active entries that match), lists (their lists, sorted and
    comma-joined), entry (the deciding one as kind:pattern) and decision: block if the most
    specific matching entry (prefix before host before domain, then the longer pattern) blocks, else
    keep; at equal rank an allowing entry decides. A domain entry covers its subdomains; a
    prefix entry is a host with a path up to a / or a whole path. Matching ignores case.
    A URL that is null or has no host, or a null time, matches nothing and is kept. There is one
    row for each input row, repeated rows and null ids included; empty lists keep everything.
    An entry's own intervals do not overlap, so a key meets at most one row for each list and kind.
    """
    valid = intervals(entries)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(at_col).cast("timestamp").alias("at"))
    # Equal captures are looked up once, and put back at the end.
    rows = rows.groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("copies")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    depth = valid.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))), F.lit(1))).first()[0]  # one number
    keys = F.coalesce(_keys(F.col("host"), F.col("path"), depth), F.array(F.struct(F.lit("none").alias("kind"), F.lit("").alias("key"))))
    rows = rows.select("id", "url", "at", "host", "copies", F.explode(keys).alias("k")).select("id", "url", "at", "host", "copies", "k.kind", "k.key")
    right = small(valid.withColumnRenamed("kind", "of_kind"), BROADCAST_ENTRIES)
    on = (F.col("kind") == F.col("of_kind")) & (F.col("key") == F.col("pattern")) & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = rows.join(right, on, "left")
    rank = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"), F.length("pattern").alias("size"), (F.col("action") == "allow").alias("allow"), F.concat_ws(":", "kind", "pattern").alias("entry"))
    one = met.groupBy("id", "url", "at").agg(
        F.first("host").alias("host"),
        F.first("copies").alias("copies"),
        F.count("pattern").alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.max(F.when(F.col("pattern").isNotNull(), rank)).alias("best"),
    )
    decision = F.when(F.col("best").isNull() | F.col("best.allow"), F.lit("keep")).otherwise(F.lit("block"))
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return one.select(F.col("id").alias(id_col), "host", F.col("at").alias("fetched_at"), "n_entries", "lists", F.col("best.entry").alias("entry"), decision.alias("decision"))
