"""Scalar functions as Columns: every one is made of built-in expressions, so plans stay in generated code."""

from __future__ import annotations

import zoneinfo
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = r"^[+]?[0-9]+$"
SIGNED = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i)(inf|infinity|nan))$"
#: Largest values of unsigned types; 64 bits are kept as a long.
LIMITS = {"u8": 255, "u16": 65535, "u32": 4294967295, "u64": 9223372036854775807}
INTEGERS = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "bigint"}
#: Milliseconds since 1970 of 0001-01-02 and of 9999-12-31.
CLOCK_MILLIS = (-62_135_510_400_000, 253_402_214_400_000)
#: The zone in which the search index writes its clock times.
INDEX_ZONE = "Europe/Berlin"


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_number(text: Column, kind: str) -> Column:
    """A number of one of :data:`INTEGERS` or f32, f64; null if the text isn't exactly one or is out of range.

    Unlike a plain cast this takes no spaces, no type letters and no fractions for integers. Integers of
    kind u64 from 2**63 on are out of range.
    """
    if kind in ("f32", "f64", "f"):
        return F.when(text.rlike(FLOAT), text.try_cast("float" if kind == "f32" else "double"))
    pattern = UNSIGNED if kind.startswith("u") else SIGNED
    wide = F.when(text.rlike(pattern), text.try_cast("bigint"))
    if kind in LIMITS:
        wide = F.when(wide <= LIMITS[kind], wide)
    return wide.try_cast(INTEGERS[kind])


def line_id(prefix: Column, suffix: Column) -> Column:
    """Prefix and suffix joined by a space, white space around them left out; null if nothing is left."""
    return F.nullif(line_name(prefix, suffix), F.lit(""))


def line_name(prefix: Column, suffix: Column) -> Column:
    """The same, empty if nothing is left: ``nullif`` takes its value twice, which expressions over arrays compute twice."""
    return F.regexp_replace(F.concat_ws(" ", prefix, suffix), r"(?U)^\s+|\s+$", "")


def money(cents: Column) -> Column:
    """Cents as decimal(10, 2); null if they don't fit."""
    return (cents.try_cast("decimal(10,0)") * F.lit(Decimal("0.01"))).try_cast("decimal(10,2)")


def is_clock_time(millis: Column) -> Column:
    """Whether milliseconds since 1970 are a time of the years 1 to 9999, with a day to spare for zones."""
    return millis.between(CLOCK_MILLIS[0], CLOCK_MILLIS[1])


def utc_naive(millis: Column) -> Column:
    """Milliseconds since 1970 as a UTC clock time without a zone; null outside the years 1 to 9999. The session's zone plays no part."""
    return _naive(F.when(is_clock_time(millis), millis.cast("bigint")))


def _naive(millis: Column) -> Column:
    return F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_instant(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint"))


def convert_naive(source: Column, target: Column, clock: Column) -> Column:
    """A clock time of zone ``source`` as that of zone ``target``."""
    return F.convert_timezone(source, target, clock)


def is_gap(clock: Column, zone: Column) -> Column:
    """Whether a clock time does not exist in a zone (it is skipped when clocks go forward)."""
    utc = F.lit("UTC")
    return convert_naive(utc, zone, convert_naive(zone, utc, clock)) != clock


def is_overlap(clock: Column, zone: Column) -> Column:
    """Whether a clock time exists twice in a zone (clocks go back by an hour or half an hour)."""
    utc = F.lit("UTC")
    instant = convert_naive(zone, utc, clock)
    shifted = [convert_naive(utc, zone, instant + F.expr(f"INTERVAL {m} MINUTES")) == clock for m in (-60, -30, 30, 60)]
    return reduce(lambda a, b: a | b, shifted)


def rebased(millis: Column, zone: Column, clock: Column | None = None, offset: Column | None = None) -> Column:
    """(instant, local, tz): the clock that :data:`INDEX_ZONE` shows at ``millis``, read as the clock of ``zone``.

    ``instant`` is the UTC clock time (without a zone) of that local time. A gap moves forward and an overlap takes the
    earlier instant; :func:`clock_problem` tells of both. ``clock`` and ``offset``, of :class:`feedspark.functions.offsets.Offsets`, spare the conversions
    where they aren't null; where ``offset`` isn't, there is no problem.
    """
    local = convert_naive(F.lit("UTC"), F.lit(INDEX_ZONE), utc_naive(millis))
    if clock is not None:
        local = F.coalesce(_naive(clock), local)
    instant = convert_naive(zone, F.lit("UTC"), local)
    if clock is not None and offset is not None:
        instant = F.coalesce(_naive(clock - offset), instant)
    return F.when(is_clock_time(millis) & zone.isNotNull(), F.struct(instant.alias("instant"), local.alias("local"), zone.alias("tz")))


def clock_problem(r: Column) -> Column:
    """Why a rebased time isn't certain (gap, overlap); null if it is.

    An overlap shows twice what a clock shows an hour or half an hour away, so the four comparisons are made only where the
    zone's offset changes within an hour.
    """
    utc, hour = F.lit("UTC"), F.expr("INTERVAL 60 MINUTES")
    quiet = convert_naive(utc, r["tz"], r["instant"] + hour) == convert_naive(utc, r["tz"], r["instant"] - hour) + F.expr("INTERVAL 120 MINUTES")
    gap = convert_naive(utc, r["tz"], r["instant"]) != r["local"]
    return F.when(gap, F.lit("gap")).when(~quiet & is_overlap(r["local"], r["tz"]), F.lit("overlap"))


def zone_names() -> list[str]:
    """The names of the IANA zones."""
    return sorted(n for n in zoneinfo.available_timezones() if n not in ("localtime", "posixrules", "Factory"))


def is_zone(name: Column) -> Column:
    """Whether a text is the name of an IANA zone (offsets and Java's short names aren't)."""
    return F.coalesce(name.isin(zone_names()), F.lit(False))


def credential(text: Column) -> Column:
    """(id, key) from base64 of ``id:key``; null unless there are exactly these two parts."""
    parts = F.split(F.try_to_binary(text, F.lit("base64")).cast("string"), ":")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("id"), parts[1].alias("key")))


def empty_if_null(values: Column, kind: str) -> Column:
    return F.coalesce(values, F.array().cast(kind))


def file_stem(path: Column) -> Column:
    """A file's name without folders and last extension."""
    return F.regexp_extract(path, r"([^/\\]+?)([.][^./\\]*)?$", 1)


def code_label(code: Column, codes: dict) -> Column:
    """The label of a code; null for an unknown one."""
    pairs = [F.lit(x) for k, v in codes.items() for x in (k, v)]
    key = "string" if isinstance(next(iter(codes)), str) else "int"
    return F.try_element_at(F.create_map(*pairs), code.cast(key))


def join_url(base: str, path: str) -> str:
    return f"{base.rstrip('/')}/{path.lstrip('/')}"
