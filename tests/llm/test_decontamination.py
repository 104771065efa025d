from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from feedspark.llm import decontamination as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, item_id string"


def words(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(lower)


def brute(docs, items):
    out = {}
    for did, text in docs:
        w, hit, held = words(text), set(), set()
        for iid, t in items:
            x = words(t)
            size = min(13, len(x))
            for k in range(len(x) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[k : k + size]:
                        hit.update(range(p, p + size))
                        held.add(str(iid))
        names = ",".join(sorted(held))
        out[did] = (len(w), len(hit), len(held), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_matches_brute_force(spark):
    long = " ".join(f"w{i % 37} Tail{i}" for i in range(3000))
    item = " ".join(f"Term{i}" for i in range(20))
    items = [(1, item), (2, "short one"), (3, ""), (4, None), (10, item), (5, "a " * 14)]
    docs = [
        (1, "x " + item.upper() + " y"),
        (2, " ".join(item.split()[2:15]) + ". " + " ".join(item.split()[7:20])),
        (3, None),
        (4, ""),
        (5, "the Short, ONE!"),
        (6, "short\none" * 3),
        (7, long + " " + item + long),
        (8, "a-b " * 20 + " a" * 30),
        (9, " ".join(item.split()[:12])),
        (None, "short one"),
        (11, "éclair short one ünter"),
    ]
    got = D.decontaminate(spark.createDataFrame([(*d, "clash") for d in docs], DOCS).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)
    assert len(got) == len(docs)


def test_several_passes_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_WORDS", 3)
    docs = [(1, "one two three four"), (1, "one two three four"), (2, "five")]
    items = [(1, "one two"), (2, "three four"), (3, "two three"), (3, "five")]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert sorted(map(tuple, got)) == sorted((d, *want[d]) for d, _ in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.decontaminate(docs, items).count() == 0
    one = D.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), items).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in one] == [(2, 0, 0, False)]


def test_proximity(spark):
    index = D.build_index(spark.createDataFrame([(1, "red x x blue x x x x red"), (2, "blue"), (3, "red")], "doc_id bigint, text string").coalesce(1)).collect()
    seg = D.Segment(*list(index[0])[1:])
    at, there = seg.numbers(D.words_of("red blue"))
    assert there.all()
    assert seg.near(at, 3).tolist() == [0] and seg.near(at[::-1], 3).tolist() == [3]
    assert seg.near(at, 2).tolist() == []
    assert np.array_equal(seg.phrase(seg.numbers(D.words_of("x blue x"))[0]), [2])


def test_phrase_and_proximity_searches(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_DOCS", 3)
    rng = random.Random(3)
    docs = [(f"d{i}", " ".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for i in range(40)] + [(None, "a b"), ("n", None)]
    index = D.written(D.build_index(spark.createDataFrame(docs, "doc_id string, text string").repartition(3)), "test_index")
    queries = [("one", "a b"), ("two", "c a d"), ("none", ""), ("unknown", "a zz"), ("same", "b b")]
    got = sorted((str(r.id), r.query, r.start) for r in D.find_phrases(index, queries).collect())
    want = sorted((str(d), q, i) for d, t in docs for q, x in queries if x for i in range(len(words(t))) if words(t)[i : i + len(x.split())] == words(x))
    assert got == want and len(want) > 20
    near = {(str(r.id), r.query, r["at"]) for r in D.find_near(index, queries, 2).collect()}
    want = set()
    for d, t in docs:
        w = words(t)
        for q, x in queries:
            need = words(x)
            want |= {(str(d), q, i) for i in range(len(w)) if need and w[i] == need[0] and all(n in w[max(0, i - 2) : i + 3] for n in need)}
    assert near == want and {q for _, q, _ in want} == {"one", "two", "same"}


@pytest.mark.parametrize("kind", ["date", "decimal(9,2)", "smallint", "double"])
def test_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "one two"), (2, "x"), (None, "one two")], "n int, text string").selectExpr(f"CAST({'date_add(DATE' + chr(39) + '2024-01-01' + chr(39) + ', n)' if kind == 'date' else 'n'} AS {kind}) AS doc_id", "text")
    got = D.decontaminate(docs, spark.createDataFrame([(7, "one two")], "item_id int, text string"))
    assert got.schema["doc_id"].dataType.simpleString() == kind
    assert sorted((str(r.doc_id), r.n_hit) for r in got.collect()) == sorted((str(r.doc_id), 2 if r.text == "one two" else 0) for r in docs.collect())
