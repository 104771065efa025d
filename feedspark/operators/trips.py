"""Trip documents: nested search hits cleaned with expressions over arrays, with station zones looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions import scalars as S
from feedspark.functions.offsets import Offsets
from feedspark.sources.stations import common_zones, constant_lookup, station_zones

# The documents' fields and the kinds of vehicles.
SEGMENT = "struct<index:bigint,operating_carrier:struct<uid:string>,line:string,line_prefix:string,departure_time:bigint,arrival_time:bigint,departure_station:struct<uid:string>,arrival_station:struct<uid:string>,vehicle:struct<type:string>>"
FARE = "struct<price:bigint,fare_class:struct<uid:string>>"
RAW = (
    "snapshot_id string, snapshot_timestamp bigint, snapshot_uid string, departure_time bigint, arrival_time bigint, total_price bigint, currency string, booked_out boolean, "
    "electronic_ticket_available boolean, departure_date string, departure_station struct<uid:string>, arrival_station struct<uid:string>, marketing_carrier struct<uid:string>, "
    f"departure_city struct<uid:string>, arrival_city struct<uid:string>, departure_area struct<uid:string>, arrival_area struct<uid:string>, segments array<{SEGMENT}>, fares array<{FARE}>"
)
ENVELOPE = f"hits struct<total:struct<value:bigint>,hits:array<struct<_source:struct<{RAW.replace(' ', ':').replace(',:', ',')}>>>>"
VEHICLES = ("BUS", "TRAIN", "TRAM", "FERRY")
_NEEDED = ("snapshot_id", "snapshot_timestamp", "snapshot_uid", "departure_time", "arrival_time", "total_price", "currency", "booked_out", "departure_date", "departure_station.uid", "arrival_station.uid", "marketing_carrier.uid", "departure_city", "arrival_city", "departure_area", "arrival_area", "segments")
_TIMES = ("snapshot_timestamp", "departure_time", "arrival_time")
Lookup = Callable[[Column], Column]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents from files with one JSON document a line."""
    return spark.read.schema(RAW).option("mode", "PERMISSIVE").json(path)


def parse_responses(df: DataFrame, column: str = "body", mode: str = "FAILFAST") -> DataFrame:
    """Raw documents from a column of whole search responses; a response that isn't as declared fails the job, or in mode
    PERMISSIVE gives no documents."""
    body = F.from_json(column, ENVELOPE, {"mode": mode})
    return df.select(F.explode(body["hits"]["hits"]).alias("h")).select("h._source.*")


def total_hits(df: DataFrame, column: str = "body") -> DataFrame:
    """(total_hits) of each search response: how many documents match it in the index, whatever the page holds."""
    return df.select(F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"})["hits"]["total"]["value"].alias("total_hits"))


#: The parts of `_zoned`, as a struct or as columns.
Zoned = Column | dict[str, Column]


def _zoned(s: Column, zone: Lookup, offsets: Offsets) -> dict[str, Column]:
    """A segment, its stations' zones, its clocks and its line, each found once: what a step uses more than once, the step before has made."""
    return {
        "raw": s, "dep_zone": zone(s["departure_station"]["uid"]), "arr_zone": zone(s["arrival_station"]["uid"]),
        "dep_clock": offsets.clock(s["departure_time"]), "arr_clock": offsets.clock(s["arrival_time"]), "line": S.line_name(s["line_prefix"], s["line"]),
    }


def _departure(z: Zoned, offsets: Offsets) -> Column:
    return S.rebased(z["raw"]["departure_time"], z["dep_zone"], z["dep_clock"], offsets.offset(z["dep_clock"], z["dep_zone"]))


def _arrival(z: Zoned, offsets: Offsets) -> Column:
    return S.rebased(z["raw"]["arrival_time"], z["arr_zone"], z["arr_clock"], offsets.offset(z["arr_clock"], z["arr_zone"]))


def _segment(z: Zoned, offsets: Offsets) -> list[Column]:
    """The fields of a clean segment."""
    same = [z["raw"][c].alias(c) for c in ("departure_station", "arrival_station", "vehicle")]
    return [F.nullif(z["line"], F.lit("")).alias("line"), _departure(z, offsets).alias("departure_time"), _arrival(z, offsets).alias("arrival_time"), *same]


def _once(value: Column) -> Column:
    """The same value, computed once for a row: a filter on what depends on it (the one that ``explode`` brings, too) isn't pushed below it, where all would be computed again."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _problem(rebased: Column, zone: Column, offset: Column) -> Column:
    """Whether a rebased time isn't certain; no change is near where there is an offset."""
    return F.when(zone.isNotNull() & offset.isNull(), S.clock_problem(rebased).isNotNull())


def _segment_errors(z: Zoned, offsets: Offsets) -> Column:
    s = z["raw"]
    checks = [
        (s["departure_station"]["uid"].isNull() | s["arrival_station"]["uid"].isNull(), "segment without a station"),
        (s["departure_time"].isNull() | s["arrival_time"].isNull() | (s["departure_time"] < 0) | (s["arrival_time"] < 0), "segment without a time"),
        (~S.is_clock_time(s["departure_time"]) | ~S.is_clock_time(s["arrival_time"]), "segment at a bad time"),
        (s["index"].isNull() | (s["index"] < 0) | s["operating_carrier"]["uid"].isNull(), "segment without index or carrier"),
        (~F.coalesce(s["vehicle"]["type"].isin(*VEHICLES), F.lit(False)), "segment of an unknown vehicle"),
        (s["departure_station"]["uid"].isNotNull() & z["dep_zone"].isNull(), "segment from a station without a zone"),
        (s["arrival_station"]["uid"].isNotNull() & z["arr_zone"].isNull(), "segment to a station without a zone"),
        (_problem(_departure(z, offsets), z["dep_zone"], offsets.offset(z["dep_clock"], z["dep_zone"])), "segment leaves at a time that is skipped or comes twice"),
        (_problem(_arrival(z, offsets), z["arr_zone"], offsets.offset(z["arr_clock"], z["arr_zone"])), "segment arrives at a time that is skipped or comes twice"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def _clean(raw: DataFrame, zone: Lookup, offsets: Offsets, legacy_arrival_zone: bool) -> DataFrame:
    own, other = zone(F.col("departure_station.uid")), zone(F.col("arrival_station.uid"))
    arr_zone = F.col("_dep_zone") if legacy_arrival_zone else F.col("_arr_zone")
    zoned = F.transform("segments", lambda s: F.struct(*[c.alias(n) for n, c in _zoned(s, zone, offsets).items()]))
    rows = raw.withColumns({"_dep_zone": own, "_arr_zone": other, "_dep_clock": offsets.clock(F.col("departure_time")), "_arr_clock": offsets.clock(F.col("arrival_time"))})
    rows = rows.withColumns({"_dep_offset": offsets.offset(F.col("_dep_clock"), F.col("_dep_zone")), "_arr_offset": offsets.offset(F.col("_arr_clock"), arr_zone)})
    rows = rows.withColumns({"_dep": S.rebased(F.col("departure_time"), F.col("_dep_zone"), F.col("_dep_clock"), F.col("_dep_offset")), "_arr": S.rebased(F.col("arrival_time"), arr_zone, F.col("_arr_clock"), F.col("_arr_offset"))})
    checks = [(F.col(c).isNull(), f"{c}: no value") for c in _NEEDED]
    checks += [((F.col(c) < 0) | ~S.is_clock_time(F.col(c)), f"{c}: bad value") for c in _TIMES]
    checks += [(~F.col("total_price").between(0, S.LIMITS["u32"]), "total_price: bad value")]
    checks += [(F.col("departure_station.uid").isNotNull() & F.col("_dep_zone").isNull(), "departure_station: no zone"), (F.col("arrival_station.uid").isNotNull() & arr_zone.isNull(), "arrival_station: no zone")]
    checks += [(_problem(F.col("_dep"), F.col("_dep_zone"), F.col("_dep_offset")), "departure_time: skipped or twice"), (_problem(F.col("_arr"), arr_zone, F.col("_arr_offset")), "arrival_time: skipped or twice")]
    checks += [(F.exists("fares", lambda f: f["price"].isNull() | (f["price"] < 0) | (f["price"] > S.LIMITS["u32"]) | f["fare_class"]["uid"].isNull()), "fares: bad value")]
    errors = F.concat(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks])), F.coalesce(F.flatten(F.transform(zoned, lambda z: _segment_errors(z, offsets))), F.array().cast("array<string>")))
    fare = lambda f: F.struct(S.money(f["price"]).alias("price"), f["fare_class"].alias("fare_class"), F.col("currency").alias("currency"))
    same = ("booked_out", "electronic_ticket_available", "departure_date", "departure_station", "arrival_station", "marketing_carrier", "departure_city", "arrival_city", "departure_area", "arrival_area")
    return rows.select(
        "snapshot_id",
        S.utc_naive(F.col("snapshot_timestamp")).alias("snapshot_timestamp"),
        "snapshot_uid",
        F.col("_dep").alias("departure_time"),
        F.col("_arr").alias("arrival_time"),
        S.money(F.col("total_price")).alias("total_price"),
        "currency",
        *same,
        _once(F.transform(zoned, lambda z: F.struct(*_segment(z, offsets)))).alias("segments"),
        F.transform(S.empty_if_null(F.col("fares"), f"array<{FARE}>"), fare).alias("fares"),
        _once(F.array_distinct(errors)).alias("_errors"),
    )


def _joined_zones(raw: DataFrame, zones: DataFrame) -> tuple[DataFrame, Lookup]:
    """For a dimension that is too large for a constant: the zones of each document's few stations, by a join."""
    own = F.array_distinct(F.concat(F.array("departure_station.uid", "arrival_station.uid"), S.empty_if_null(F.flatten(F.transform("segments", lambda s: F.array(s["departure_station"]["uid"], s["arrival_station"]["uid"]))), "array<string>")))
    # Documents with equal stations share their lookup.
    keyed = raw.withColumn("_stations", F.array_sort(F.array_compact(own)))
    met = keyed.select("_stations").distinct().select("_stations", F.explode("_stations").alias("code")).join(zones, "code")
    maps = met.groupBy("_stations").agg(F.map_from_entries(F.collect_list(F.struct("code", "time_zone"))).alias("_zones"))
    return keyed.join(maps, "_stations", "left"), lambda code: F.try_element_at(F.col("_zones"), code)


def _looked_up(raw: DataFrame, stations: DataFrame, constant: bool) -> tuple[DataFrame, Lookup, Offsets]:
    """Documents, and what finds a station's zone and a zone's offset for them."""
    zones = station_zones(stations)
    lookup = constant_lookup(zones) if constant else None
    if lookup is None:
        raw, lookup = _joined_zones(raw, zones)
    return raw, lookup, Offsets(raw.sparkSession, common_zones(zones))


def clean_trips(raw: DataFrame, stations: DataFrame, legacy_arrival_zone: bool = False, constant: bool = True) -> DataFrame:
    """Clean documents with ``_errors``, from raw ones and station entries (code, time_zone, pos).

    Money becomes decimal, line names are merged, null fares an empty array and fares get their document's currency.
    Times become (instant, local, tz): see :func:`feedspark.functions.scalars.rebased`. The arrival is rebased to the arrival
    station's zone, or to the departure station's with ``legacy_arrival_zone``. ``_errors`` lists
    missing and bad values (money and times that don't fit are null), stations without a zone, unknown vehicles and times that a clock skips or shows twice. The order of
    segments is kept. The dimension is a constant of the plan while it is small enough, and joined beyond.
    """
    raw, lookup, offsets = _looked_up(raw, stations, constant)
    return _clean(raw, lookup, offsets, legacy_arrival_zone)


def clean_segments(raw: DataFrame, stations: DataFrame, constant: bool = True) -> DataFrame:
    """The segments that exploding :func:`clean_trips` gives, one row each, with the ``snapshot_id`` of their document and a column for each field.

    They are exploded before they are cleaned: rows are cleaned by generated code, while Spark interprets expressions over arrays.
    """
    raw, lookup, offsets = _looked_up(raw, stations, constant)
    zones = ["_zones"] if "_zones" in raw.columns else []
    rows = raw.select("snapshot_id", *zones, F.explode("segments").alias("s"))
    zoned = _zoned(F.col("s"), lookup, offsets)
    # Columns and no struct: a struct's parts would be computed again wherever they are used.
    rows = rows.select("snapshot_id", *[c.alias(n) for n, c in zoned.items()])
    return rows.select("snapshot_id", *_segment({n: F.col(n) for n in zoned}, offsets))
