from __future__ import annotations

import random
import re

import numpy as np
import pytest

from feedspark.llm import near_dedup as N
from feedspark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, words=3, percent=85):
    """(doc_id, n_shingles, component_id, kept) with real strings, all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), d == find(d)) for (d, _), s in zip(rows, sets, strict=True))


def corpus(seed, groups, copies, edits, length=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, copies)):
            x = list(base)
            for _ in range(rng.randint(0, edits)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            out.append(" ".join(x))
    rng.shuffle(out)
    return list(enumerate(out))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, component_id string").repartition(4)
    return sorted(map(tuple, N.near_duplicates(df).collect()))


def test_matches_brute_force(spark):
    rows = corpus(1, 40, 8, 3)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one "), (n + 5, "two words"), (n + 6, "TWO\x0bwords"), (n + 7, "ünder Straße x y"), (n + 8, "long " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_five_words_and_four_fifths(spark):
    rows = corpus(3, 40, 8, 2, 150)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, N.near_duplicates(df, words=5, percent=80).collect())) == brute(rows, 5, 80)
    assert (N.agreeing(85), N.agreeing(80)) == (40, 36)


def test_large_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "BLOCK_DOCS", 6)
    monkeypatch.setattr(N, "PIVOTS", 1)
    rows = corpus(2, 4, 60, 4, 80)
    assert run(spark, rows) == brute(rows)


def test_shuffled_joins_beyond_the_broadcast_bounds(spark, monkeypatch):
    for name in ("BROADCAST_IDS", "BROADCAST_PIVOTS"):
        monkeypatch.setattr(N, name, -1)
    monkeypatch.setattr(components.__globals__["F"], "broadcast", lambda df: pytest.fail("a broadcast beyond its bound"))
    monkeypatch.setitem(components.__globals__, "BROADCAST_EDGES", -1)
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "BLOCK_DOCS", 6)
    rows = corpus(5, 3, 40, 4, 80)
    assert run(spark, rows) == brute(rows)


def boilerplate(n, shared, own, pairs):
    """Unlike documents that share a long opening, and copies of some with one word changed."""
    rng = random.Random(9)
    opening = [f"s{i}" for i in range(shared)]
    docs = [opening + [f"d{k}x{rng.randrange(10**6)}" for _ in range(own)] for k in range(n)]
    docs += [[*docs[k][:-1], "changed"] for k in range(pairs)]
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def test_unlike_documents_that_share_their_opening(spark):
    n, pairs = 3000, 150
    rows = boilerplate(n, 40, 60, pairs)
    got = run(spark, rows)
    assert [(d, c) for d, _, c, _ in got] == [(k, k if k < n else k - n) for k in range(n + pairs)]
    sig = N.written(N.signatures(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, "doc_id", "text"), "test")
    nodes = sig.groupBy("node").agg(*(N.F.first(c).alias(c) for c in ("n", "tokens", "sketch")))
    edges = N.proposals(nodes, 85)
    assert pairs <= edges.count() <= 2 * n  # of 4.9 million pairs


def test_all_but_a_few_near_the_pivot(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(N, "RIM", 32)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for share in [200] * 120 + [150] * 40 + [90] * 60:  # copies, rims, and texts of which less than half is common
        x = base[:share] + [f"r{rng.randrange(10**7)}" for _ in range(200 - share)]
        for _ in range(rng.randrange(4)):
            x[rng.randrange(share)] = f"c{rng.randrange(10**7)}"
        docs.append(x)
    docs += [[*x[:-1], "end"] for x in docs[120:220:3]]
    rows = [(k, " ".join(x)) for k, x in enumerate(docs)]
    assert run(spark, rows) == brute(rows)


def test_rows_with_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (2, "a b c d"), (2, "a b c d"), (1, "a b c d"), (7, "x y z")], "doc_id bigint, text string")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (7, 1, 7, True)], key=str)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 101), (200, 100), (30, 0), (50, 51), (50, 51), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100, 50: 50, 51: 50}


@pytest.mark.parametrize("cells", [7, 1 << 20])
def test_links_are_exact(monkeypatch, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(25)]
    a, b = N.links_within(sets, 60)
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
