from __future__ import annotations

import numpy as np
import pytest

from feedspark.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k, step):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % step == 0:
            s = sorted(((-float((x * good[q]).sum()), i) for i, x in good.items() if i != q and len(x) == len(good[q])))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def search(spark, rows, k=20, step=20):
    got = N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), lambda i: i % step == 0, k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_over_shards(spark, monkeypatch, unit):
    monkeypatch.setattr(N, "SHARD_ROWS", 700)
    monkeypatch.setattr(N, "BLOCK", 8)  # the queries of a shard are shared by several tasks
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, (2500, 1))
    rows = [(i, v.astype(np.float32).tolist(), "clash") for i, v in enumerate(x)]
    got, want = search(spark, rows), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for q, found in got.items():
        exact = dict(brute(rows, 2500, 20)[q]) if q < 40 else {}
        assert all(s == pytest.approx(exact.get(i, s), abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_odd_vectors_and_ties(spark):
    same = [0.5, 0.5]
    rows = [(0, same, ""), (1, same, ""), (2, same, ""), (3, [0.0, 0.0], ""), (4, None, ""), (5, [float("nan"), 1.0], ""), (6, [float("inf"), 1.0], ""), (7, [None, 1.0], ""), (20, [-1.0, 0.0], ""), (None, same, ""), (8, [], ""), (40, [1.0, 2.0, 3.0], ""), (41, [1.0, 0.0, 0.0], ""), (60, None, ""), (2, same, "")]
    got = search(spark, rows)
    assert got == {0: [(1, 0.5), (2, 0.5), (20, -0.5)], 20: [(0, -0.5), (1, -0.5), (2, -0.5)], 40: [(41, 1.0)]}


def test_empty(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA), lambda i: i % 20 == 0).count() == 0


def test_prefix_ranges():
    rng = np.random.default_rng(1)
    f = N.Forest.build(np.arange(300), rng.normal(size=(300, 8)))
    q = f.sorted[:, :5].copy()
    for level in (0, 1, 5, f.bits):
        lo, hi = f.ranges(q, np.full(q.shape, level))
        for t in range(N.TREES):
            for i in range(5):
                shift = np.uint64(f.bits - level)
                want = np.flatnonzero((f.sorted[t] >> shift) == (q[t, i] >> shift))
                assert (lo[t, i], hi[t, i]) == (want[0], want[-1] + 1)


def test_ascent_ends_with_just_enough():
    rng = np.random.default_rng(2)
    f = N.Forest.build(np.arange(4000), rng.normal(size=(4000, 16)))
    q = N.codes(np.c_[rng.normal(size=(6, 16)), np.zeros(6)], f.ways, 16)
    level = f.levels(q)
    assert (level.max(axis=0) - level.min(axis=0) <= 1).all()
    held = np.subtract(*f.ranges(q, level)[::-1])
    wanted = N.LEAST + N.ENOUGH * 4000**N.POWER
    assert (held.sum(axis=0) >= wanted).all()
    last = np.argmax(level == level.max(axis=0), axis=0) - 1  # the last tree that ascended
    some = last >= 0
    deeper = np.subtract(*f.ranges(q, level + 1)[::-1])
    assert (held.sum(axis=0) - (held - deeper)[last, np.arange(6)] < wanted)[some].all()


def test_candidates_grow_less_than_the_shard():
    many = []
    for n in (2000, 16_000):
        x = np.random.default_rng(3).normal(size=(n, 64))
        f = N.Forest.build(np.arange(n), x / np.linalg.norm(x, axis=1, keepdims=True))
        found = list(f.candidates(f.x[:40], 21))
        near = np.argsort(-(f.x[:40] @ f.x.T), axis=1)[:, :21]
        assert np.mean([np.isin(near[i], found[i]).mean() for i in range(40)]) >= 0.9
        many.append(np.mean([len(c) for c in found]))
    assert many[1] < 5.5 * many[0]


def test_copies_take_the_room_of_one(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)).astype(np.float32).tolist()
    rows = [(i, v, "") for i, v in enumerate(x)] + [(i, x[0], "") for i in range(900, 2400)]
    got, want = search(spark, rows, step=100), brute(rows, 20, 100)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == list(range(900, 920))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_products_that_overflow(spark):
    rows = [(0, [1e308, -1e308]), (1, [1e308, 1e308]), (2, [1e308, 0.0]), (3, [-1e308, 0.0]), (4, [1.0, 1.0])]
    got = {r.vec_id: r["rank"] for r in N.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda i: i == 0).collect()}
    assert got == {2: 1, 4: 2, 3: 3, 1: 4}  # infinite, 0, minus infinite, no number
