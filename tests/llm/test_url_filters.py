from __future__ import annotations

from datetime import datetime

import pytest

from feedspark.llm import url_filters as U
from feedspark.llm.queries import OP9_SQL, op9_url_filters

ENTRIES = "list string, kind string, pattern string, action string, event string, at timestamp, seq int"
DATA = "/root/testdata/sf0.001"


def day(n):
    return datetime(2024, 1, n)


def decide(spark, captures, entries):
    rows = U.filter_captures(spark.createDataFrame([(*c, "clash") for c in captures], "page_id bigint, url string, fetched_at timestamp, list string"), spark.createDataFrame(entries, ENTRIES)).collect()
    return sorted(((r.page_id, r.host, r.n_entries, r.lists, r.entry, r.decision) for r in rows), key=str)


def test_intervals(spark):
    e = [("a", "host", "X.com", "block", "add", day(1), 1), ("a", "host", "x.com", "block", "remove", day(3), 2), ("a", "host", "x.com", "block", "add", day(5), 3), ("a", "host", "y.com", "block", "add", day(2), 4), ("a", "host", "y.com", "block", "remove", day(2), 5), ("a", "host", None, "block", "add", day(2), 6), ("a", "host", "z.com", "block", "remove", day(2), 7)]
    got = U.intervals(spark.createDataFrame(e, ENTRIES)).collect()
    assert sorted((r.pattern, r.valid_from.day, r.valid_to and r.valid_to.day) for r in got) == [("x.com", 1, 3), ("x.com", 5, None)]


def test_decisions(spark):
    e = [
        ("l1", "domain", "bad.com", "block", "add", day(2), 1),
        ("l1", "domain", "bad.com", "block", "remove", day(9), 2),
        ("l2", "host", "good.bad.com", "allow", "add", day(1), 3),
        ("l3", "prefix", "good.bad.com/x/", "block", "add", day(4), 4),
        ("l4", "prefix", "good.bad.com/x/", "allow", "add", day(6), 5),
        ("l5", "prefix", "p.com/a/b", "block", "add", day(1), 6),
    ]
    c = [
        (1, "http://www.BAD.com/q", day(1)),
        (2, "http://www.BAD.com./q", day(2)),
        (3, "https://u:p@bad.com:80?x#y", day(8)),
        (4, "http://bad.com/", day(9)),
        (5, "http://good.bad.com/y", day(3)),
        (6, "http://good.bad.com/X/y/z?u=/x/", day(5)),
        (7, "http://good.bad.com/x/", day(7)),
        (8, "http://notbad.com", day(3)),
        (9, None, day(3)),
        (10, "no url", day(3)),
        (11, "http://bad.com", None),
        (None, "http://bad.com", day(3)),
        (12, "http://p.com/a/b", day(3)),
        (13, "http://p.com/a/bc", day(3)),
        (12, "http://p.com/a/b", day(3)),
        (14, "", day(3)),
        (15, "http://bad.com/" + "a/" * 300, day(3)),
    ]
    want = [
        (1, "www.bad.com", 0, "", None, "keep"),
        (2, "www.bad.com", 1, "l1", "domain:bad.com", "block"),
        (3, "bad.com", 1, "l1", "domain:bad.com", "block"),
        (4, "bad.com", 0, "", None, "keep"),
        (5, "good.bad.com", 2, "l1,l2", "host:good.bad.com", "keep"),
        (6, "good.bad.com", 3, "l1,l2,l3", "prefix:good.bad.com/x/", "block"),
        (7, "good.bad.com", 4, "l1,l2,l3,l4", "prefix:good.bad.com/x/", "keep"),
        (8, "notbad.com", 0, "", None, "keep"),
        (9, None, 0, "", None, "keep"),
        (10, None, 0, "", None, "keep"),
        (11, "bad.com", 0, "", None, "keep"),
        (None, "bad.com", 1, "l1", "domain:bad.com", "block"),
        (12, "p.com", 1, "l5", "prefix:p.com/a/b", "block"),
        (12, "p.com", 1, "l5", "prefix:p.com/a/b", "block"),
        (13, "p.com", 0, "", None, "keep"),
        (14, None, 0, "", None, "keep"),
        (15, "bad.com", 1, "l1", "domain:bad.com", "block"),
    ]
    assert decide(spark, c, e) == sorted(want, key=str)


@pytest.mark.parametrize("captures", [[], [(1, "http://a.com", day(1))]])
def test_empty(spark, captures):
    assert decide(spark, captures, []) == [(c[0], "a.com", 0, "", None, "keep") for c in captures]


def test_oracle(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    want = c.execute(OP9_SQL).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(r) for r in op9_url_filters(spark, DATA).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {"keep", "block"}


def test_very_long_paths_and_shuffled_lists(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_ENTRIES", -1)
    e = [("l", "prefix", "p.com/a/b/", "block", "add", day(1), 1), ("l", "prefix", "p.com/" + "a/" * 40, "allow", "add", day(1), 2)]
    c = [(1, "http://p.com/a/b/" + "c/" * 60_000, day(2)), (2, "http://p.com/" + "a/" * 50_000, day(2)), (3, "http://p.com/a/", day(2))]
    assert decide(spark, c, e) == [(1, "p.com", 1, "l", "prefix:p.com/a/b/", "block"), (2, "p.com", 1, "l", "prefix:p.com/" + "a/" * 40, "keep"), (3, "p.com", 0, "", None, "keep")]
