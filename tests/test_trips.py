from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from feedspark.functions import scalars as S
from feedspark.operators import trips as T
from feedspark.sources import stations as ST

STATIONS = [("ber", "Europe/Berlin", 0), ("nyc", "America/New_York", 1), ("lon", "Europe/London", 2), ("bad", "Mars/Olympus", 3), ("nyc", "America/Chicago", 4), ("nyc", "Nowhere/Atall", 5), (None, "UTC", 6)]
ENTRIES = "code string, time_zone string, pos bigint"
MS = 1686829530123  # 2023-06-15 11:45:30.123 UTC


def segment(**k):
    return {"index": 0, "operating_carrier": {"uid": "c"}, "line": "7", "line_prefix": "N", "departure_time": MS, "arrival_time": MS + 1000, "departure_station": {"uid": "ber"}, "arrival_station": {"uid": "nyc"}, "vehicle": {"type": "BUS"}} | k


def document(**k):
    uid = {"uid": "x"}
    base = {"snapshot_id": "a", "snapshot_timestamp": MS, "snapshot_uid": "u", "departure_time": MS, "arrival_time": MS, "total_price": 1299, "currency": "EUR", "booked_out": False, "departure_date": "2023-06-15"}
    base |= {"departure_station": {"uid": "nyc"}, "arrival_station": {"uid": "lon"}, "marketing_carrier": uid, "departure_city": {}, "arrival_city": uid, "departure_area": {"uid": None}, "arrival_area": uid}
    return base | {"segments": [segment()], "fares": [{"price": 4294967295, "fare_class": {"uid": "f"}}], "extra": 1} | k


def clean(spark, docs, **k):
    raw = parse(spark, docs)
    return T.clean_trips(raw, spark.createDataFrame(STATIONS, ENTRIES), **k).collect()


def parse(spark, docs):
    body = json.dumps({"took": 3, "hits": {"total": {"value": len(docs)}, "hits": [{"_id": "1", "_source": d} for d in docs]}})
    return T.parse_responses(spark.createDataFrame([(body,)], "body string"))


@pytest.mark.parametrize("constant", [True, False])
def test_clean_document(spark, constant):
    r = clean(spark, [document()], constant=constant)[0]
    assert r._errors == []
    assert r.total_price == Decimal("12.99") and r.fares[0].price == Decimal("42949672.95") and r.fares[0].currency == "EUR"
    assert r.snapshot_timestamp == dt.datetime(2023, 6, 15, 11, 45, 30, 123000)
    local = dt.datetime(2023, 6, 15, 13, 45, 30, 123000)
    assert (r.departure_time.local, r.departure_time.tz, r.departure_time.instant) == (local, "America/Chicago", local + dt.timedelta(hours=5))
    assert (r.arrival_time.tz, r.arrival_time.instant) == ("Europe/London", local - dt.timedelta(hours=1))
    s = r.segments[0]
    assert s.line == "N 7" and s.departure_time.tz == "Europe/Berlin" and s.arrival_time.tz == "America/Chicago" and s.vehicle.type == "BUS"
    assert r.departure_city.uid is None and r.electronic_ticket_available is None


def test_legacy_arrival_zone(spark):
    assert clean(spark, [document()], legacy_arrival_zone=True)[0].arrival_time.tz == "America/Chicago"


@pytest.mark.parametrize("constant", [True, False])
def test_errors(spark, constant):
    docs = [
        document(snapshot_id="b", arrival_station={"uid": "bad"}),
        document(snapshot_id="c", fares=None, segments=[]),
        document(snapshot_id="d", segments=[segment(vehicle={"type": "ROCKET"}), segment(line=None, line_prefix=" ", departure_station={"uid": "none"})]),
        document(snapshot_id="e", total_price=4294967296, currency=None),
        document(snapshot_id="f", departure_time=1679789700000, departure_station={"uid": "nyc"}, arrival_station={"uid": "ber"}),
        document(snapshot_id="g", arrival_time=1698539400000, arrival_station={"uid": "ber"}),
        document(snapshot_id="h", fares=[{"price": -1, "fare_class": {"uid": "f"}}], segments=None),
    ]
    got = {r.snapshot_id: r for r in clean(spark, docs, constant=constant)}
    assert got["b"]._errors == ["arrival_station: no zone"] and got["b"].arrival_time is None
    assert got["c"]._errors == [] and got["c"].fares == [] and got["c"].segments == []
    assert set(got["d"]._errors) == {"segment of an unknown vehicle", "segment from a station without a zone"} and got["d"].segments[1].line is None
    assert set(got["e"]._errors) == {"currency: no value", "total_price: bad value"}
    assert got["f"]._errors == []
    assert got["g"]._errors == ["arrival_time: skipped or twice"]
    assert set(got["h"]._errors) == {"segments: no value", "fares: bad value"}


def test_values_that_do_not_fit_are_quarantined(spark):
    docs = [
        document(snapshot_id="a", total_price=10**11),
        document(snapshot_id="b", departure_time=10**16, arrival_time=-(10**17)),
        document(snapshot_id="c", snapshot_timestamp=2**62),
        document(snapshot_id="d", fares=[{"price": 2**62, "fare_class": {"uid": "f"}}]),
        document(snapshot_id="e", segments=[segment(departure_time=10**16), segment()]),
        document(snapshot_id="f"),
    ]
    got = {r.snapshot_id: r for r in clean(spark, docs)}
    assert {k: r._errors for k, r in got.items()} == {
        "a": ["total_price: bad value"], "b": ["departure_time: bad value", "arrival_time: bad value"], "c": ["snapshot_timestamp: bad value"],
        "d": ["fares: bad value"], "e": ["segment at a bad time"], "f": [],
    }
    assert got["a"].total_price is None and got["b"].departure_time is None and got["c"].snapshot_timestamp is None and got["d"].fares[0].price is None
    assert got["e"].segments[0].departure_time is None and got["e"].segments[1].departure_time is not None


def test_total_hits(spark):
    body = ['{"hits": {"total": {"value": 250}, "hits": []}}', '{"hits": {"hits": []}}', "{", None]
    assert [r.total_hits for r in T.total_hits(spark.createDataFrame([(b,) for b in body], "body string")).collect()] == [250, None, None, None]


def test_bad_response_fails(spark):
    df = spark.createDataFrame([('{"hits": {"hits": [{"_source": {"snapshot_id": "a", "total_price": "x"}}]',)], "body string")
    with pytest.raises(Exception, match="(?i)malformed"):
        T.parse_responses(df).collect()
    assert T.parse_responses(df, mode="PERMISSIVE").count() <= 1


def test_stations(spark, tmp_path):
    p = tmp_path / "stations.json"
    p.write_text(json.dumps({"data": [{"id": i, "attributes": {"code": c, "time_zone": z}} for i, (c, z, _) in enumerate(STATIONS)]}))
    zones = ST.station_zones(ST.read_stations(spark, f"file://{p}"))
    assert {tuple(r) for r in zones.collect()} == {("ber", "Europe/Berlin"), ("nyc", "America/Chicago"), ("lon", "Europe/London")}
    empty = spark.createDataFrame([], ENTRIES)
    assert ST.station_zones(empty).count() == 0 and ST.constant_lookup(empty) is not None


def test_large_dimensions_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ST, "CONSTANT_STATIONS", 1)
    assert ST.constant_lookup(ST.station_zones(spark.createDataFrame(STATIONS, ENTRIES))) is None


def test_scalars(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), (None, None), (" ", "\t"), (" x", "y "), ("", "")], "p string, s string")
    assert [r[0] for r in df.select(S.line_id(df.p, df.s)).collect()] == ["a b", "b", "a", None, None, "x y", None]
    zone = spark.createDataFrame([("Europe/Berlin",), ("+01:00",), ("UTC+3",), (None,), ("europe/berlin",), ("UTC",)], "z string")
    assert [r[0] for r in zone.select(S.is_zone(zone.z)).collect()] == [True, False, False, False, False, True]
    text = spark.createDataFrame([("aWQ6a2V5",), ("aWQ=",), ("YTpiOmM=",), ("%%%",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in text.select(S.credential(text.t)).collect()] == [("id", "key"), None, None, None, None]
    assert S.join_url("http://h/", "/a") == "http://h/a"


def test_offsets_give_what_conversions_give(spark):
    from feedspark.functions.offsets import Offsets

    zones = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "UTC", "Asia/Tokyo"]
    o = Offsets(spark, zones[:-1])  # times of the last zone are converted
    # Every seven hours of sixteen years, and times outside the stretches and the clock.
    times = spark.range(0, 20_000).selectExpr("1293840000000 + id * 25200000 + id % 7 * 600000 AS ms").union(spark.createDataFrame([(v,) for v in (None, 0, -1, 2**62, -(2**63), 253402214400000, 631151999999, 2524608000000, 2523916800000)], "ms bigint"))
    df = times.crossJoin(spark.createDataFrame([(z,) for z in [*zones, None]], "z string")).withColumn("clock", o.clock(S.F.col("ms"))).withColumn("offset", o.offset(S.F.col("clock"), S.F.col("z")))
    c = S.F.col
    df = df.select("ms", "z", "offset", S.rebased(c("ms"), c("z"), c("clock"), c("offset")).alias("quick"), S.rebased(c("ms"), c("z")).alias("exact"))
    df = df.withColumns({"problem": S.clock_problem(c("exact"))})
    assert df.where("NOT quick <=> exact OR offset IS NOT NULL AND problem IS NOT NULL").count() == 0
    share = df.where("z = 'Europe/Berlin' AND ms BETWEEN 1293840000000 AND 1797840000000").selectExpr("avg(CAST(offset IS NULL AS double)) AS v").first().v
    assert 0 < share < 0.15 and df.where("z = 'Asia/Tokyo' AND offset IS NOT NULL").count() == 0 and df.where("problem IS NOT NULL").count() > 0


def test_a_filter_does_not_clean_twice(spark):
    raw = parse(spark, [document()])
    clean_rows = T.clean_trips(raw, spark.createDataFrame(STATIONS, ENTRIES))
    for df in (clean_rows.where("size(_errors) > 0").select("snapshot_id", "_errors"), clean_rows.selectExpr("explode(segments) AS s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "dep_zone" in plan and all("dep_zone" not in line for line in plan.splitlines() if "Filter" in line)


@pytest.mark.parametrize("constant", [True, False])
def test_clean_segments_are_those_of_clean_trips(spark, constant):
    docs = [
        document(snapshot_id="a", segments=[segment(), segment(line=None, line_prefix=" ", departure_station={"uid": "none"}), segment(departure_time=10**16, arrival_time=None)]),
        document(snapshot_id="b", segments=[]),
        document(snapshot_id="c", segments=None),
        document(snapshot_id="d", segments=[None, segment(line=" x\u3000", line_prefix=None, departure_time=1679789700000, arrival_time=1698539400000, arrival_station={"uid": "ber"}), segment(departure_station=None, vehicle=None)]),
    ]
    stations = spark.createDataFrame(STATIONS, ENTRIES)
    want = T.clean_trips(parse(spark, docs), stations, constant=constant).selectExpr("snapshot_id", "inline(segments)")
    got = T.clean_segments(parse(spark, docs), stations, constant=constant)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 6


def test_segments_are_cleaned_by_generated_code(spark):
    from feedspark.plans import queries as Q

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # Spark interprets functions over arrays; a plan shows their arguments as lambdas.
    assert "lambda" not in plan(Q.q_nested_segments(spark, "/root/testdata/sf0.001"))
    assert "lambda" not in plan(Q._documents(spark, "/root/testdata/sf0.001"))


def test_a_line_is_named_once(spark):
    rows = T.clean_trips(parse(spark, [document()]), spark.createDataFrame(STATIONS, ENTRIES)).select(S.F.size("segments"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_money_is_exact(spark):
    cents = [0, 1, -1, 99, -199, 4294967295, 9_999_999_999, -9_999_999_999, 10**10, -(10**10), 2**62, None]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cents)], "i int, c bigint").orderBy("i").select(S.money(S.F.col("c"))).collect()]
    assert got == [None if c is None or abs(c) >= 10**10 else Decimal(c).scaleb(-2) for c in cents]
