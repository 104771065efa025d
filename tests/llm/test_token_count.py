from __future__ import annotations

import random
import unicodedata

import public_tokenizers
import pytest

from feedspark.llm import token_count as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def text():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def samples():
    out = [a + chr(c) + b for c in range(0x260) for a in ("", "a", " ", "1") for b in ("", "a", " ")]
    return [*out, "a<|endoftext|>b  <|endoftext|>", "  x   \n\n y\t\t", "don't I'LL 'tis", "", "a \x1c\x1d b", "漢字 mixed 🙂", "a" * 3000, "é" * 2000 + " "]


def test_counts_equal_the_library(text, monkeypatch):
    monkeypatch.setattr(T, "CALL_CHARS", 300)
    tok, x = T.load(text), samples()
    want = [len(tok.encode(s, add_special_tokens=False).ids) for s in x]
    assert T.Counter(text, T.prove_single(text)).count(x) == want


def test_all_scripts_take_the_shortcut(text):
    rng = random.Random(1)
    known = [chr(c) for c in range(T.FAST_BELOW, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    x = [a + c + b for c in rng.sample(known, 700) for a in ("", "a", " ", "1", "!") for b in ("", "a", " ")]
    some = [chr(c) for lo, hi in ((0x410, 0x450), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (0x2010, 0x2028), (0x3041, 0x3090), (0x627, 0x64A)) for c in range(lo, hi)]
    x += ["".join(rng.choice([*some, *([" ", "we'll"] * 90)]) for _ in range(40)) for _ in range(300)]
    c, tok = T.Counter(text, T.prove_single(text)), T.load(text)
    assert c.count(x) == [len(tok.encode(s, add_special_tokens=False).ids) for s in x]
    assert not any(c.odd.search(s) for s in x)  # none went to the library whole
    odd = ["a\u0378b", "\ue000 x", "\U000e0fff"]  # unassigned and private
    assert all(c.odd.search(s) for s in odd)
    assert c.count(odd) == [len(tok.encode(s, add_special_tokens=False).ids) for s in odd]


def test_small_memo(text, monkeypatch):
    single = T.prove_single(text)
    monkeypatch.setattr(T, "MEMO", len(single) + 5)
    monkeypatch.setattr(T, "CALL_CHARS", 50)
    tok = T.load(text)
    x = [f"zqxj{i} vrrk{i * 7} {'longword' * 12}{i}" for i in range(50)]
    c = T.Counter(text, single)
    assert c.count(x) == [len(tok.encode(s, add_special_tokens=False).ids) for s in x]
    assert max(map(len, set(c.memo) - set(single)), default=0) <= T.MEMO_CHARS


def test_proof(text):
    tok = T.load(text)
    single = T.prove_single(text)
    assert len(single) > 45_000
    assert all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in single[::97])


def test_rows(spark, text):
    tok = T.load(text)
    rows = [(1, "hello wörld", 5), (None, None, 1), (3, "", 2), (3, "", 2), (4, "token " * 600, 0)]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), PATH).collect()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert T.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_other_tokenizer_goes_to_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = f.read()
    c = T.Counter(other, [])
    assert c.pattern is None
    assert c.count(["Some words", ""]) == [len(T.load(other).encode(s, add_special_tokens=False).ids) for s in ("Some words", "")]
