"""Offsets of zones in stretches of time in which they don't change, so that most times are rebased by sums.

Converting between zones parses the zones' names for each value; a sum doesn't. Where a zone's offset changes near a time, or the time is in
no stretch, there is no offset here, and the conversion is made.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.scalars import INDEX_ZONE

#: A stretch has 2**29 milliseconds (six days); the first begins in 1990, the last ends in 2050.
BITS = 29
FIRST, LAST = 631_152_000_000 >> BITS, 2_524_608_000_000 >> BITS
#: Milliseconds around a stretch in which the offset doesn't change either: more than clocks are apart, and an hour.
AROUND = 30 * 3_600_000
#: Zones of which a plan holds the offsets; times of further ones are converted.
ZONES = 32


@lru_cache(maxsize=1024)
def _changes(spark: SparkSession, zone: str) -> tuple[int, list[tuple[int, int]]]:
    """The offset in seconds at the beginning, and the changes after it (milliseconds, offset), by the rules of the JVM that converts."""
    jvm = spark.sparkContext._jvm
    rules = jvm.java.time.ZoneId.of(zone).getRules()
    at = jvm.java.time.Instant.ofEpochMilli((FIRST << BITS) - AROUND)
    before, found = rules.getOffset(at).getTotalSeconds(), []
    while (change := rules.nextTransition(at)) is not None:
        at = change.getInstant()
        if at.toEpochMilli() > ((LAST + 1) << BITS) + AROUND:
            break
        found.append((at.toEpochMilli(), change.getOffsetAfter().getTotalSeconds()))
    return before, found


def quiet_offsets(spark: SparkSession, zone: str) -> list[int | None]:
    """Seconds by which a zone is ahead of UTC in each stretch; None where it changes in it or near it."""
    now, changes = _changes(spark, zone)
    out: list[int | None] = []
    for n in range(FIRST, LAST + 1):
        begin, end = (n << BITS) - AROUND, ((n + 1) << BITS) + AROUND
        while changes and changes[0][0] < begin:
            now, changes = changes[0][1], changes[1:]
        out.append(None if changes and changes[0][0] <= end else now)
    return out


class Offsets:
    """The offsets of the index's zone and of some zones, as constants of a plan."""

    def __init__(self, spark: SparkSession, zones: list[str]) -> None:
        of = {z: _millis(spark, z) for z in zones[:ZONES]}
        self.index = F.from_json(F.lit(json.dumps({"v": _millis(spark, INDEX_ZONE)})), "struct<v:array<bigint>>")["v"]
        self.zones = F.from_json(F.lit(json.dumps({"v": of})), "struct<v:map<string,array<bigint>>>")["v"]

    def clock(self, millis: Column) -> Column:
        """What the index's clock shows at ``millis``, as milliseconds; null where it takes a conversion."""
        return millis + F.get(self.index, _stretch(millis))

    def offset(self, clock: Column, zone: Column) -> Column:
        """Milliseconds by which a zone is ahead of UTC when its clock shows ``clock``, no change being near; null where it takes a conversion."""
        return F.get(F.try_element_at(self.zones, zone), _stretch(clock))


def _stretch(millis: Column) -> Column:
    return F.shiftright(millis, BITS).try_cast("int")


def _millis(spark: SparkSession, zone: str) -> list[int | None]:
    """Milliseconds by which a zone is ahead in each stretch since 1970, so that a time's stretch is its place."""
    return [None] * FIRST + [None if s is None else s * 1000 for s in quiet_offsets(spark, zone)]
