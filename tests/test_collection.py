from __future__ import annotations

import zipfile

import pytest

from feedspark.operators import collection as C
from feedspark.registry import tables
from feedspark.sources.archive import FeedError, open_folder, stage_archive
from feedspark.sources.csvio import read_table

FEED = {
    "agency.txt": "agency_id,agency_name,agency_url,agency_timezone\n1,A,u,Europe/Berlin\n",
    "feed/stops.txt": "stop_id,stop_name,location_type\ns1,One,0\ns2,Two,5\n",
    "routes.csv": "route_id,agency_id,route_type\nr,1,3\n",
    "trips.txt": "route_id,service_id,trip_id\nr,w,t\n",
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time\nt,s1,1,25:00:00\nt,s2,2,\n",
    "levels.txt": "level_id,level_index,level_name\nl,no number,x\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nx,1.5,-2,0\n",
    "readme.md": "nothing",
}


def archive(tmp_path, **changes):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (FEED | changes).items():
            if text is not None:
                z.writestr(name, text)
    return f"file://{path}"


def test_load(spark, tmp_path):
    feed = C.load_feed(spark, stage_archive(spark, archive(tmp_path)))
    assert feed.counts == {"agency": 1, "stops": 2, "routes": 1, "trips": 1, "stop_times": 2, "shapes": 1}
    assert feed.tables["levels"] is None and "1 of 1 rows" in feed.problems["levels"] and feed.problems["pathways"] == "missing"
    assert list(feed.tables) == list(tables())
    feed.register("v_")
    assert spark.sql("SELECT stop_name FROM v_stops WHERE location_type = 5").first()[0] == "Two"
    assert [r.stop_id for r in feed.rows("stops")] == ["s1", "s2"] and list(feed.rows("levels")) == []


def test_required_tables(spark, tmp_path):
    with pytest.raises(FeedError, match="trips: missing"):
        C.load_feed(spark, stage_archive(spark, archive(tmp_path, **{"trips.txt": None})))
    bad = archive(tmp_path, **{"routes.csv": "route_id,agency_id,route_type\nr,1,8\nq,1,3\n"})
    with pytest.raises(FeedError, match="routes: 1 of 2"):
        C.load_feed(spark, stage_archive(spark, bad))
    feed = C.load_feed(spark, stage_archive(spark, bad), quarantine=True)
    assert feed.counts["routes"] == 1 and feed.counts["levels"] == 0 and "routes" in feed.problems
    checked = C.read_feed(spark, stage_archive(spark, bad))
    assert {(r.table_name, r.error, r.n) for r in C.rejected(checked).collect()} == {("routes", "routes.route_type: bad value", 1), ("levels", "levels.level_index: bad value", 1)}


def test_two_members_for_a_table(spark, tmp_path):
    with pytest.raises(FeedError, match="stops"):
        stage_archive(spark, archive(tmp_path, **{"old/stops.csv": "stop_id\n"}))


def test_archive_and_folder_round_trip(spark, tmp_path):
    feed = C.load_feed(spark, stage_archive(spark, archive(tmp_path)))
    C.export_feed(feed, f"file://{tmp_path}/out")
    again = C.load_feed(spark, open_folder(spark, f"file://{tmp_path}/out"))
    assert again.counts == feed.counts
    C.export_archive(spark, {n: df for n, df in feed.tables.items() if df is not None}, f"file://{tmp_path}/again.zip")
    third = C.load_feed(spark, stage_archive(spark, f"file://{tmp_path}/again.zip"))
    assert third.counts == feed.counts
    assert third.tables["stop_times"].collect() == feed.tables["stop_times"].collect()


def test_simple_route(spark):
    r = C.simple_route(spark.createDataFrame([("a", "n")], "agency_id string, short_name string")).first()
    assert len(r.route_id) == 36 and (r.agency_id, r.route_short_name, r.route_type, r.route_color, r.continuous_pickup) == ("a", "n", 3, "FFFFFF", 1)


def test_every_table_reads_its_own_export(spark, tmp_path):
    # A row of valid values for each of the 19 tables.
    for name, spec in tables().items():
        row = [str(next(iter(c.codes))) if c.codes else {"s": "text", "f": "1.5"}.get(c.kind, "7") for c in spec.columns]
        p = tmp_path / f"{name}.csv"
        p.write_text(",".join(c.name for c in spec.columns) + "\n" + ",".join(row) + "\n")
        got = read_table(spark, f"file://{p}", spec).first()
        assert got._errors == [] and all(v is not None for v in got), name


def test_written_tables_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from feedspark.sources import scratch

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(spark)


def test_appended_rows_come_back_in_order(spark):
    from feedspark.sources.appended import AppendedTable

    t = AppendedTable(spark, "a int, b string")
    assert t.in_order().count() == 0
    t.append(spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "b string, a int"))
    t.append(spark.createDataFrame([], "a int, b string"))
    t.append(spark.createDataFrame([(3, None), (3, "x")], "a int, b string"))
    assert [tuple(r) for r in t.in_order().collect()] == [(3, "x"), (1, "y"), (2, "z"), (3, None), (3, "x")]


def test_an_archive_is_written_without_rows_in_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*a, **k):
        raise AssertionError("rows came to the driver")

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, refused)
    rows = spark.range(5000, numPartitions=7).selectExpr("id AS level_id", "if(id % 9 = 0, 'a \"b\",\nc', string(id)) AS level_name", "if(id % 4 = 0, NULL, id) AS level_index")
    C.export_archive(spark, {"levels": rows, "agency": spark.range(0).selectExpr("id AS agency_id")}, f"file://{tmp_path}/x.zip")
    want = ["level_id,level_name,level_index", *[f'{i},{chr(34) + "a " + chr(34) * 2 + "b" + chr(34) * 2 + "," + chr(10) + "c" + chr(34) if i % 9 == 0 else i},{i if i % 4 else ""}' for i in range(5000)]]
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and z.namelist() == ["levels.txt", "agency.txt"]
        assert z.read(z.namelist()[0]).decode() == "\n".join(want) + "\n" and z.read(z.namelist()[1]) == b"agency_id\n"
