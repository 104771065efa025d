from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from feedspark.llm import toxicity as T
from feedspark.llm.boosting import Boosted, Isotonic
from feedspark.llm.queries import op2_toxicity
from feedspark.llm.shingles import IS_ALNUM_WORD, word_hashes

WORDS = [f"word{i}" for i in range(200)]


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(WORDS, rng.integers(5, 80)))
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["idiot", "moron", "grobnak"])))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return T.train(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1)], "doc_id bigint, toxic int"))


def test_held_out(spark, model):
    docs, labels = corpus(300, 2)
    got = {r.doc_id: r for r in T.score(spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id bigint, text string, score int"), model).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert len(model.learned.hashes) > 0  # 'grobnak' was learned


def test_inflected_words_are_known_by_their_beginning(spark):
    rng = np.random.default_rng(4)
    ends = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(400)]
    docs = [(i, " ".join([*rng.choice(WORDS, 30), *(f"grobn{rng.choice(ends)}" for _ in range(3 * (i % 4 == 0)))])) for i in range(600)]
    m = T.train(spark.createDataFrame(docs[:400], "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int"))
    rest = spark.createDataFrame([(i, t, "x") for i, t in docs[400:]], "doc_id bigint, text string, toxic string")
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in T.score(rest, m).collect()]) > 0.97
    kept = T.keep_clean(rest, m)
    assert kept.columns == rest.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in T.score(rest, m).collect() if not r.predicted}


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "idiot"), (4, "idiot " * 40_000), (4, "\n\n"), (5, "ünïcödé 🙂")]
    got = T.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert T.score(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_no_labels(spark):
    m = T.train(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert 0 <= T.score(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), m).first().score <= 1


def test_features():
    empty = T.Lexicon(np.empty(0, np.uint64))
    m = T.Model(empty, empty)
    texts = ["You are an IDIOT, moron!", "1d1ot and m.o.r.o.n\nsc*um", "nothing here", "", "a\nb\n\nidiot"]
    f = dict(zip(T.FEATURES, m.features(texts).T, strict=True))
    assert f["insults"].tolist() == [2, 0, 0, 0, 1]
    assert f["insult_kinds"].tolist() == [2, 0, 0, 0, 1]
    assert f["near_second_person"].tolist() == [2, 0, 0, 0, 0]
    assert f["hidden"].tolist() == [0, 3, 0, 0, 0]
    assert f["densest_insults"].tolist() == [2, 0, 0, 0, 1]
    assert f["capital_words"][0] == pytest.approx(1 / 5)


def test_features_do_not_depend_on_neighbours(monkeypatch):
    m = T.Model(T.Lexicon(np.empty(0, np.uint64)), T.Lexicon(np.empty(0, np.uint64)))
    texts = [t for _, t in corpus(50)[0]] + ["", "x\ny", "\n"]
    whole = m.features(texts)
    monkeypatch.setattr(T, "CHUNK", 64)
    assert np.allclose(m.features(texts), whole)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    b = Boosted(60).fit(x[:2000], y[:2000])
    assert ((b.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    iso = Isotonic().fit(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert iso.y.tolist() == [0, 0.5, 1.0] and iso.x.tolist() == [1, 2.5, 4.5]
    assert iso.apply(np.array([-9.0, 9.0])).tolist() == [0.0, 1.0]


def hash_of(word):
    return int(word_hashes(word.encode(), IS_ALNUM_WORD)[0][0])


def test_features_against_plain_python():
    empty = T.Lexicon(np.empty(0, np.uint64))
    m = T.Model(T.Lexicon(np.array([hash_of("grobnak")], np.uint64), np.array([2.5])), empty)
    texts = [t for _, t in corpus(40, 3)[0]] + ["YOU ARE Grobnak!? 12a", "sooo   baaad, idiot... YoU", "a1 b2 33"]
    f = dict(zip(T.FEATURES, m.features(texts).T, strict=True))
    for i, text in enumerate(texts):
        w = re.findall(r"[A-Za-z0-9]+", text)
        low, letters, solid = [x.lower() for x in w], re.findall(r"[A-Za-z]", text), re.sub(r"\s", "", text)
        hits = [k for k, x in enumerate(low) if x in T.INSULTS]
        learned = [k for k, x in enumerate(low) if x == "grobnak"]
        persons = [k for k, x in enumerate(low) if x in T.SECOND_PERSON]
        both = sorted({*hits, *learned})
        want = {
            "log_words": math.log1p(len(w)), "insults": len(hits), "insult_share": len(hits) / len(w), "insult_kinds": len({low[k] for k in hits}),
            "densest_insults": max((sum(a <= b < a + T.STRETCH for b in hits) for a in hits), default=0), "learned": len(learned), "learned_weight": 2.5 * len(learned), "stems": 0,
            "near_second_person": sum(any(abs(a - b) <= T.NEAR for b in persons) for a in both), "second_person_share": len(persons) / len(w),
            "upper_share": sum(c.isupper() for c in letters) / max(1, len(letters)), "capital_words": sum(len(x) > 1 and x[0].isupper() and x[-1].isupper() for x in w) / len(w),
            "punctuation_share": sum(not c.isalnum() for c in solid) / len(solid), "mark_share": sum(c in "!?" for c in solid) / len(solid), "digit_share": sum(c.isdigit() for c in solid) / len(solid),
            "mixed_words": sum(any(c.isdigit() for c in x) and not x.isdigit() for x in w) / len(w), "repeated_letters": len(re.findall(r"(?=([A-Za-z])\1\1)", text)) / max(1, len(letters)),
            "mean_word": len(letters) / len(w), "bytes_a_word": len(solid) / len(w),
        }
        assert {k: float(f[k][i]) for k in want} == pytest.approx(want), text


def test_lexicons_are_learned_out_of_fold(spark):
    docs, labels = corpus(400, 7)
    y = dict(labels)
    rows = T._keyed(spark.createDataFrame([(y[i], t) for i, t in docs] * 2, "y int, text string"))
    got = T._learn_words(rows)
    seen = {(r.y, r.key): (r.text, r.fold) for r in rows.collect()}
    assert {f for _, f in seen.values()} == set(range(T.FOLDS)) and len(seen) == len({t for _, t in docs})
    for left_out, (words, _) in enumerate(got):
        used = [(k[0], set(re.findall(r"[a-z0-9]+", t.lower()))) for k, (t, f) in seen.items() if f not in (0, left_out)]
        n = [sum(v == side for v, _ in used) for side in (0, 1)]
        want = {}
        for w in {x for _, ws in used for x in ws}:
            c, t = (sum(v == side and w in ws for v, ws in used) for side in (0, 1))
            odds = math.log((t + 0.5) / (n[1] - t + 0.5)) - math.log((c + 0.5) / (n[0] - c + 0.5))
            if t >= T.LEAST_DOCS and odds - T.SURE * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= T.LEAST_ODDS:
                want[hash_of(w)] = odds
        assert dict(zip(words.hashes.tolist(), words.weights.tolist(), strict=True)) == pytest.approx(want) and len(want) >= 3


def test_a_tree_is_the_best_split():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 400) > 6).astype(float)
    b = Boosted(1, depth=1, rate=1.0).fit(x, y)
    p = y.mean()
    g, h = y - p, p * (1 - p)

    def gain(j, cut):
        left = x[:, j] <= cut
        if min(left.sum(), (~left).sum()) * h < b.least:
            return 0
        return sum(g[s].sum() ** 2 / (s.sum() * h + b.ridge) for s in (left, ~left))

    best = max((gain(j, c), j, c) for j in range(3) for c in range(12))
    assert gain(b.feature[0, 0], b.cut[0, 0]) == pytest.approx(best[0])
    left = x[:, b.feature[0, 0]] <= b.cut[0, 0]
    assert b.value[0] == pytest.approx([g[s].sum() / (s.sum() * h + b.ridge) for s in (left, ~left)])


def test_held_out_labels_are_not_used(spark, tmp_path):
    docs, labels = corpus(300, 8)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    assert 30 < sum(held.values()) < 90
    found = []
    for n, lie in enumerate((False, True)):
        at = f"{tmp_path}/{n}"
        spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1 - y if lie and held[i] else y) for i, y in labels], "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
        got = op2_toxicity(spark, at).collect()
        assert {r.doc_id: r.held_out for r in got} == held
        found.append(sorted((r.doc_id, r.score, r.predicted) for r in got))
    assert found[0] == found[1]
