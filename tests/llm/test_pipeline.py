from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P  # noqa: E402
from test_decontamination import brute as brute_hits  # noqa: E402
from test_mixing import targets  # noqa: E402
from test_near_dedup import WORD  # noqa: E402
from test_near_dedup import brute as brute_groups  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=500):
    rng = np.random.default_rng(11)
    vocab = {lang: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"), ("cc", "абвгдежз"))}
    items = [(f"item-{k}", " ".join(f"bench{k}w{i}" for i in range(30))) for k in range(4)]
    docs, labels = [], []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        w = [str(x) for x in rng.choice(vocab[lang], rng.integers(10, 60))]
        if i % 7 == 0:
            w[3:3] = ["idiot", "moron", "scum"]
        if i % 11 == 0:
            w[5:5] = items[i % 4][1].split()[:20]
        docs.append((i, " ".join(w), None if i % 50 == 1 else lang, ["x", "y", None][i % 3 if i % 5 else 0]))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 7 == 0)))
    for i in range(n, n + 60):  # copies, some with one word changed
        w = docs[i % 40][1].split()
        if i % 2:
            w[len(w) // 2] = "other"
        docs.append((i, " ".join(w), docs[i % 40][2], "copies"))
    docs += [(n + 60, None, "aa", "x"), (n + 61, "", "aa", "x"), (n + 62, "123 456 !!", "aa", "x"), (n + 63, docs[1][1].upper() + " extra " * 20_000, None, None)]
    long = [str(x) for x in rng.choice(vocab["aa"], 900)]
    long[400:400] = items[2][1].split()[:15]
    docs.append((n + 64, " ".join(long), "aa", "y"))
    return [(*d, len(d[1] or "")) for d in docs], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = P.written(stage(spark, docs, folder), f"test_{name}")
        rows = out.collect()
        text = [(i, now[i].text) for i in sorted(now)]
        if k < 4:
            assert out.columns == columns and all(r == now[r.doc_id] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
            kept = {r.doc_id for r in rows}
        if name == "toxicity":
            assert kept == {i for i, t in text if "idiot" not in (t or "").split()}
        elif name == "language_id":
            assert kept == {i for i, t in text if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            assert kept == {d for d, _, _, own in brute_groups(text, 5, 80) if own} and len(kept) < len(text) - 30
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            hits = brute_hits(text, items)
            assert kept == {d for d, x in hits.items() if not x[1]} and len(kept) < len(text)
            assert any(x[1] and not x[4] for x in hits.values())  # a passage in a long document
        else:
            size = {i: len(WORD.findall((t or "").encode())) for i, t in text}
            sizes: dict = {}
            for i in now:
                sizes[now[i].source] = sizes.get(now[i].source, 0) + size[i]
            want, taken, copies = targets(sizes), dict.fromkeys(sizes, 0), {}
            for r in rows:
                assert r.text == now[r.doc_id].text and r.taken == r.size == size[r.doc_id] and 1 <= r.copy <= r.copies <= 2
                taken[r.source] += r.taken
                copies.setdefault(r.doc_id, []).append((r.copy, r.copies))
            assert all(sorted(c for c, _ in x) == list(range(1, x[0][1] + 1)) for x in copies.values())
            assert all(abs(taken[s] - t) <= 0.02 * t + 60 for s, t in want.items())
        docs, now = out, {r.doc_id: r for r in rows}


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, folder), "again")
    order = ["doc_id", "copy"]
    assert P.run(spark, folder).orderBy(order).collect() == docs.orderBy(order).collect()


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).selectExpr("*", "'x' AS size", "1 AS copies", "2 AS Target", "'k' AS node", "7 AS fold", "'t' AS score", "doc_id AS id", "5 AS kept")
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, folder), f"clash_{name}")
        if name != "mixing":
            assert out.columns == docs.columns and out.where("size <> 'x' OR kept <> 5").isEmpty()
            docs = out
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "fold", "score", "id", "kept", "copy", "copies", "size", "source_size", "target", "taken"]
    assert out.where("size <> taken").isEmpty() and not out.isEmpty()


def test_odd_rows(spark, folder):
    rows = [(None, "abc abd abe", "aa", None, 1), (None, None, None, None, None), (3, "abc abd abf", "aa", "x", 1), (3, "abc abd abf", "aa", "x", 1), (4, "Abc abd abf", None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = P.near_dedup_stage(spark, docs, folder).collect()
    assert sorted((r.doc_id for r in got), key=str) == [3, None, None]
    assert P.decontaminate(spark, docs, folder).count() == len(rows)
    assert {r.doc_id for r in P.identify_language(spark, docs, folder).collect()} == {None, 3, 4}
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).count() == 0
