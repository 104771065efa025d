"""The station dimension: code to time zone."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.offsets import ZONES
from feedspark.functions.scalars import is_zone, join_url

PAYLOAD = "data array<struct<attributes:struct<code:string,time_zone:string>>>"
#: Stations up to which the dimension becomes a constant of the plan; beyond, it is joined.
CONSTANT_STATIONS = 50_000
#: Stations of a small map, about.
PER_BUCKET = 4


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """(code, time_zone, pos) from JSON files of the stations service; pos is the order in which entries come."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", True).json(path)
    return raw.select(F.posexplode("data").alias("pos", "d")).select(F.col("d.attributes.code").alias("code"), F.col("d.attributes.time_zone").alias("time_zone"), F.col("pos").cast("bigint").alias("pos"))


def fetch_stations(spark: SparkSession, base_url: str, timeout: float = 60) -> DataFrame:
    """The same from the service itself, with certificates checked. The payload is one bounded list of stations."""
    with urlopen(Request(join_url(base_url, "api/v1/stations"), headers={"Accept": "application/json"}), timeout=timeout) as r:
        data = json.load(r)["data"]
    rows = [(d["attributes"]["code"], d["attributes"]["time_zone"], i) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "code string, time_zone string, pos bigint")


def station_zones(entries: DataFrame) -> DataFrame:
    """(code, time_zone), one row a code: entries without a valid zone are left out, then the last of a code counts.

    Of entries at one pos the greatest zone counts, so reruns agree; a null code is no station.
    """
    good = entries.where(F.col("code").isNotNull() & is_zone(F.col("time_zone")))
    return good.groupBy("code").agg(F.max(F.struct("pos", "time_zone"))["time_zone"].alias("time_zone"))


def common_zones(zones: DataFrame) -> list[str]:
    """The zones of most stations, the most common first."""
    return [r.time_zone for r in zones.groupBy("time_zone").count().orderBy(F.desc("count"), "time_zone").limit(ZONES).collect()]


def constant_lookup(zones: DataFrame) -> Callable[[Column], Column] | None:
    """A function from code to zone by a constant of the plan: small maps, found by a hash of the code.

    None if there are more than ``CONSTANT_STATIONS`` stations; nothing grows with the documents.
    """
    rows = zones.limit(CONSTANT_STATIONS + 1).collect()
    if len(rows) > CONSTANT_STATIONS:
        return None
    spark = zones.sparkSession
    n_buckets = max(1, len(rows) // PER_BUCKET)
    codes = spark.createDataFrame([(r.code,) for r in rows], "code string").select("code", F.pmod(F.xxhash64("code"), F.lit(n_buckets)).cast("int").alias("b")) if rows else None
    buckets: list[dict[str, str]] = [{} for _ in range(n_buckets)]
    of = {r.code: r.time_zone for r in rows}
    for r in codes.collect() if codes is not None else []:
        buckets[r.b][r.code] = of[r.code]
    table = F.from_json(F.lit(json.dumps({"v": buckets})), "struct<v:array<map<string,string>>>")["v"]
    return lambda code: F.try_element_at(table[F.pmod(F.xxhash64(code), F.lit(n_buckets)).cast("int")], code)
