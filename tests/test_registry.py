from __future__ import annotations

import pytest

from feedspark.registry import CODES, file_name, stem, table_of, tables
from feedspark.sources.archive import FeedError, catalog


def test_tables():
    specs = tables()
    assert len(specs) == 19 and [n for n, t in specs.items() if t.required] == ["agency", "stops", "routes", "trips", "stop_times"]
    assert [c.name for c in specs["routes"].columns][:3] == ["route_id", "agency_id", "route_short_name"] and len(specs["routes"].columns) == 13
    assert specs["routes"].column("route_type").codes == CODES["RouteType"] and specs["routes"].column("route_type").required
    assert {c.kind for t in specs.values() for c in t.columns} <= {"s", "f", "u8", "u32", "u64", *CODES}
    assert all(len({c.name for c in t.columns}) == len(t.columns) for t in specs.values())


@pytest.mark.parametrize(("member", "want"), [("agency.txt", "agency"), ("x/y/stop_times.csv", "stop_times"), ("routes", "routes"), ("stops.tar.txt", None), ("Stops.txt", None), (".txt", None), ("a\\trips.txt", "trips"), ("", None)])
def test_member_to_table(member, want):
    assert table_of(member) == want


def test_catalog():
    assert stem("deep/a.b.c") == "a.b" and file_name("shapes") == "shapes.txt"
    assert catalog(["x/", "agency.txt", "notes.md", "x/stops.csv"]) == {"agency": "agency.txt", "stops": "x/stops.csv"}
    with pytest.raises(FeedError, match="stops"):
        catalog(["stops.txt", "old/stops.csv"])
    assert catalog([]) == {}
