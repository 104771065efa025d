from __future__ import annotations

import itertools
import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from feedspark.llm import language_id as L
from feedspark.llm.queries import op1_language_id

EN = "the quick brown fox jumps over the lazy dog while they think about this and that with those others".split()
DE = "der schnelle braune fuchs springt über den faulen hund während sie nicht daran denken und auch anderes tun".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку пока они думают об этом и о том другом".split()


def docs(seed=0, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang, words = [("en", EN), ("de", DE), ("ru", RU)][i % 3]
        out.append((i, " ".join(rng.choice(words, 25)), lang))
    return out


def model(spark, **k):
    return L.train(spark.createDataFrame(docs(), "doc_id bigint, text string, lang string"), **k)


def test_identifies_and_labels_spans(spark):
    m = model(spark)
    assert m.langs == ["de", "en", "ru"]
    mixed = " ".join(EN[:12]) + ". " + " ".join(DE) + ". " + " ".join(RU[:5])
    rows = [(i + 1000, t, "x") for i, t, _ in docs(5, 9)] + [(1, None, "en"), (2, "", "en"), (3, "12 34 ..!", "en"), (7, "\u2764\ufe0f 12", "en"), (8, "\u0301 \u0489\u0488!", "en"), (4, mixed, "en"), (5, "漢字", "en"), (None, "der hund", "en"), (4, mixed, "x"), (6, "fox " * 50_000, "x")]
    got = L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string"), m).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i + 1000].lang_pred for i, _, _ in docs(5, 9)] == [x for _, _, x in docs(5, 9)]
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 7, 8))
    assert by[4].lang_pred == "de"
    assert [(s.start, s.end, s.lang) for s in by[4].spans] == [(0, 12, "en"), (12, 12 + len(DE), "de"), (12 + len(DE), 17 + len(DE), "ru")]
    assert by[5].lang_pred in m.langs
    assert by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(40):
        e = rng.normal(0, 4, (6, 3))
        switch = float(rng.uniform(0.5, 8))

        def value(path):
            return sum(e[i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in itertools.pairwise(path))

        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert np.isclose(value(L.viterbi(e, switch)), best)


def test_bounded_sample_and_empty_tables(spark):
    m = model(spark, train_docs=20)
    assert set(m.langs) <= {"de", "en", "ru"}
    none = L.train(spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string"))
    assert none.langs == []
    assert L.identify(spark.createDataFrame([(1, "word")], "doc_id bigint, text string"), none).first().lang_pred == "und"
    assert L.identify(spark.createDataFrame([], "doc_id bigint, text string"), m).count() == 0


def test_groups_do_not_change_results(spark, monkeypatch):
    m = model(spark)
    texts = [t for _, t, _ in docs(9, 30)] + ["", "x"]
    whole = L.label(m, texts)
    monkeypatch.setattr(L, "CHUNK_CHARS", 100)
    assert L.label(m, texts) == whole


M64 = (1 << 64) - 1


def scramble(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> 33
        h = h * m & M64
    return h ^ h >> 33


def plain_words(text):
    """Words (runs of letters and marks with a letter) with the buckets of their trigrams and of themselves, one character at a time."""
    out, run = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            run += c
            continue
        if any(unicodedata.category(x)[0] == "L" for x in run):
            p = [0, *map(ord, run), 0]
            tri = [scramble(p[i] << 42 ^ p[i + 1] << 21 ^ p[i + 2]) for i in range(len(run))]
            out.append((run, [t % L.TRIGRAMS for t in tri], scramble(sum(tri) & M64) % L.WORDS))
        run = ""
    return out


def test_counts_and_scores_against_brute_force(spark):
    rows = docs(2, 45)
    m = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3))
    tri, word = ({x: Counter() for x in m.langs} for _ in range(2))
    for _, text, lang in rows:
        for _, t, w in plain_words(text):
            tri[lang].update(t)
            word[lang][w] += 1

    def log_share(counts, size, bucket):
        v = [math.log((counts[x][bucket] + 0.3) / (sum(counts[x].values()) + 0.3 * size)) for x in m.langs]
        return [a - sum(v) / len(v) for a in v]

    texts = [" ".join(EN[:6] + DE[:6]), "zebra e\u0301te\u0301 12x y", rows[0][1], "\u0301 a"]
    for text in texts:
        w = L.Words([text])
        got, want = m.word_scores(w), []
        for run, t, b in plain_words(text):
            s = np.sum([log_share(tri, L.TRIGRAMS, x) for x in t], axis=0) / 2 + np.array(log_share(word, L.WORDS, b)) / 2
            latin = np.array([x != "ru" for x in m.langs])
            want.append(np.where(latin, np.clip(s, -L.WORD_LIMIT, L.WORD_LIMIT), -L.WORD_LIMIT))
        assert np.allclose(got, want, atol=1e-3)


def test_held_out_labels_are_not_used(spark, tmp_path):
    rows = [(i, t, lang, "s") for i, t, lang in docs(4, 90)] + [(None, "der hund", "en", "s")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    assert 10 < sum(held) < 50
    found = []
    for n, lie in enumerate((False, True)):
        at = f"{tmp_path}/{n}"
        spark.createDataFrame([(i, t, "xx" if lie and h else lang, s) for (i, t, lang, s), h in zip(rows, held, strict=True)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
        got = op1_language_id(spark, at).collect()
        assert {(r.doc_id, r.held_out) for r in got} == {(i, h) for (i, *_), h in zip(rows, held, strict=True)}
        found.append(sorted((str(r.doc_id), r.lang_pred, r.score) for r in got))
    assert found[0] == found[1]


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LANG_DOCS", 4)
    rows = docs(6, 300) + [(1000 + i, "ναι και οχι", "el") for i in range(5)]
    assert "el" in L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_docs=9).langs
