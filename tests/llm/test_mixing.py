from __future__ import annotations

import math
import random
import re

import pytest

from feedspark.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Shares by weight; what is above a limit is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def corpus(seed, sources, n):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.paretovariate(1.3) * 8)), rng.choice(sources), "clash") for i in range(n)]


DOCS = "doc_id bigint, text string, source string, size string"


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met(spark, seed):
    rows = corpus(seed, ["b", "a", "ä", None, "Z"] + ["hot"] * 4, 1500)
    rows += [(5000, None, "a", ""), (5001, "", None, ""), (5002, "one two\x0bthree", "only", ""), (7, rows[7][1], rows[7][2], ""), (None, "a b c d", "a", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    of = {r[0]: r[2] for r in rows}
    for i, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    want = targets(sizes)
    assert {of[r.doc_id]: r.target for r in got} == pytest.approx(want)
    for s, t in want.items():
        if s != "only":
            assert abs(taken[s] - t) <= max(6, 0.002 * t), (s, taken[s], t)
    assert sorted(map(tuple, M.mix(df.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_rates_are_tilted(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "a" if i % 4 else "b", "") for i in range(600)]
    got = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    # One lambda for a source: log(rate) / size is the same wherever the limit doesn't bind.
    for s in ("a", "b"):
        tilt = {round(math.log(r.rate) / r.size, 9) for r in got if ("a" if r.doc_id % 4 else "b") == s and 0 < r.rate < 1.999}
        assert len(tilt) <= 1
        mine = [r for r in got if ("a" if r.doc_id % 4 else "b") == s]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(mine[0].target, rel=1e-6)


def test_no_words_and_no_rows(spark):
    got = M.mix(spark.createDataFrame([(1, None, "a", ""), (2, " \t", None, "")], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_one_source(spark):
    got = M.mix(spark.createDataFrame([(i, "a b c", "s", "") for i in range(100)], DOCS)).collect()
    assert sum(r.taken for r in got) == 450


def test_rates_are_tilted_and_copies_follow_them(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", -1)  # all joins by shuffle
    rows = corpus(5, ["a", "b", "c", None], 800)
    got = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r, source in ((r, dict((i, s) for i, _, s, _ in rows)[r.doc_id]) for r in got):
        by.setdefault(source, []).append(r)
    for x in by.values():
        assert sum(r.rate * r.size for r in x) == pytest.approx(x[0].target, rel=1e-6)
        tilt = [math.log(r.rate) / r.size for r in x if r.size and r.rate < 2]
        assert max(tilt, default=0) - min(tilt, default=0) < 1e-9  # one multiplier a source: the least relative entropy
        assert all(r.rate == 2 for r in x if r.size and tilt and tilt[0] * r.size >= math.log(2) + 1e-9)
        assert all(0 <= r.copies <= 2 and abs(r.copies - r.rate) < 1.2 for r in x)
