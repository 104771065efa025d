"""Licence scan: a trained n-gram classifier of paragraphs, confirmed by comparison with templates.

Training is a small proximal-gradient run over the templates of this package, their shortened and
altered copies, and ordinary sentences. Scoring is one projection of DataFrame functions: no
row leaves its partition, and the model is a literal in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.license_templates import ORDINARY, TEMPLATES

#: Altered copies of each template and sentence, for training and for calibration.
COPIES, HELD_OUT = 24, 8
ROUNDS, RATE, SPARSE = 400, 1.0, 2e-4
#: Probability that a known family must reach, and the share of a paragraph's or template's trigrams that must agree.
SURE, AGREE = 0.5, 0.5
#: A word; a version with its number is one.
WORD = r"version [0-9]+(?:[.][0-9]+)*|[a-z0-9]+(?:[.+'-][a-z0-9]+)*"
#: Where a paragraph ends: at a blank line, at a line's end after the end of a sentence, and before a line that opens a notice (with
#: a capital: the lines of a wrapped notice stay together).
OPENS = "SPDX-License-Identifier|Licen[cs]ed under|Released under|Distributed under|All rights reserved|Copyright|Permission is hereby|Redistribution and use|This (?:program|software|work|file|library|package|project|code) (?:is|may)"
PARAGRAPH = rf"\n[ \t\r]*(?=\n)|(?<=[.!?])[ \t\r]*\n|\n(?=[^A-Za-z0-9\n]*(?:{OPENS})\b)"
#: Buckets of the weights; an n-gram is looked up in the few of its own.
BUCKETS = 512
#: Words that say nothing by themselves; an n-gram counts if it holds another one.
COMMON = frozenset(
    "a an the of to in on at by for from with without and or is are was be been it its this that these those as any all not no you your he she they we their his her may can shall will which who "
    "work use used part parts file files copy copies version free general public name names form forms terms state first second two three last better new person people year site text share code "
    "law means rights source library program content conditions notice provided published included either option later received others also other along above below under over into only related "
    "available following possible extent required see at least more made 1 2 3 4 2.0 3.0 4.0 1.0 v "
    "der die das und ist im den des mit von le la les et un une de du en el los las y que".split()
)
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(words: list[str]) -> set[str]:
    """Words and pairs of words that hold a word not in :data:`COMMON`."""
    pairs = [f"{a}|{b}" for a, b in zip(words, words[1:], strict=False)]
    return {g for g in [*words, *pairs] if not COMMON.issuperset(g.split("|"))}


def trigrams(words: list[str]) -> list[str]:
    n = min(3, len(words))
    return sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else []


@dataclass(frozen=True)
class Model:
    families: list[str]  # the last is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    anchors: list[str]
    templates: list[list[list[str]]]  # trigrams of each family's templates

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(tokens(text)) if g in self.weights), np.zeros(len(self.bias)))
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _altered(words: list[str], rng: np.random.Generator, filler: list[str]) -> list[str]:
    """A copy with words left out or replaced, cut at an end, and filler around it."""
    out = [w if rng.random() > 0.06 else str(rng.choice(filler)) for w in words if rng.random() > 0.05]
    if len(out) > 8 and rng.random() < 0.4:
        k = int(rng.integers(6, len(out)))
        out = out[:k] if rng.random() < 0.5 else out[-k:]
    for _ in range(int(rng.integers(0, 8))):
        out.insert(0 if rng.random() < 0.5 else len(out), str(rng.choice(filler)))
    return out


def _examples(copies: int, seed: int, families: list[str]) -> tuple[list[set[str]], np.ndarray]:
    rng = np.random.default_rng(seed)
    filler = sorted({w for s in ORDINARY for w in tokens(s)})
    xs, ys = [], []
    for k, family in enumerate(families):
        for t in TEMPLATES.get(family, ORDINARY):
            words = tokens(t)
            for i in range(copies):
                w = words if i == 0 and seed == 0 else _altered(words, rng, filler)
                xs.append(grams(w))
                ys.append(k)
    for _ in range(40 * copies):
        xs.append(grams([str(w) for w in rng.choice(filler, int(rng.integers(1, 30)))]))
        ys.append(len(families) - 1)
    return xs, np.array(ys)


@lru_cache(maxsize=1)
def train() -> Model:
    """Sparse softmax regression with an unknown class; a temperature fitted on held-out copies calibrates it."""
    families = [*TEMPLATES, UNKNOWN]
    xs, y = _examples(COPIES, 0, families)
    known = [g for x, k in zip(xs, y, strict=True) if k < len(families) - 1 for g in x]
    counts: dict[str, int] = {}
    for g in known:
        counts[g] = counts.get(g, 0) + 1
    vocab = sorted(g for g, n in counts.items() if n >= COPIES // 4)
    number = {g: i for i, g in enumerate(vocab)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        m = np.zeros((len(rows), len(vocab)), dtype=np.float32)
        for i, r in enumerate(rows):
            m[i, [number[g] for g in r if g in number]] = 1
        return m

    x, one = matrix(xs), np.eye(len(families), dtype=np.float32)[y]
    balance = (len(y) / (len(families) * np.bincount(y, minlength=len(families))))[y][:, None].astype(np.float32)
    w, b = np.zeros((len(vocab), len(families)), np.float32), np.zeros(len(families), np.float32)
    step = RATE * 4 / max(1.0, float((x**2).sum(axis=1).mean()))

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(ROUNDS):
        g = (soft(x @ w + b) - one) * balance / len(y)
        w -= step * len(families) * (x.T @ g)
        b -= step * len(families) * g.sum(axis=0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * SPARSE)
    hx, hy = _examples(HELD_OUT, 1, families)
    z = matrix(hx) @ w + b
    temperatures = np.linspace(0.3, 3, 55)
    loss = [-np.log(np.maximum(soft(z / t)[np.arange(len(hy)), hy], 1e-12)).mean() for t in temperatures]
    keep = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    weights = {vocab[i]: [round(float(v), 5) for v in w[i]] for i in keep}
    anchors = sorted({a for g in weights for a in g.split("|") if a not in COMMON})
    return Model(families, weights, [round(float(v), 5) for v in b], float(temperatures[int(np.argmin(loss))]), anchors, [[trigrams(tokens(t)) for t in TEMPLATES[f]] for f in families[:-1]])


def _literal(value: object, kind: str) -> Column:
    """A constant of the plan: the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def _grams(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws("|", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _trigrams(words: Column) -> Column:
    n = F.least(F.lit(3), F.size(words))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def _split(text: Column) -> Column:
    """The paragraphs of a text that hold more than white space, in lower case."""
    parts = F.filter(F.split(text, PARAGRAPH), lambda p: F.length(F.trim(F.translate(p, "\n\r\t", "   "))) > 0)
    return F.transform(parts, lambda p: F.lower(p))


def _paragraphs(text: Column, anchors: Column) -> Column:
    """Words of the paragraphs that hold a word which some weighted n-gram needs; all others have the score of no n-gram."""
    all_words = F.transform(_split(text), lambda p, i: F.struct(i.alias("paragraph"), F.regexp_extract_all(p, F.lit(WORD), F.lit(0)).alias("words")))
    return F.filter(all_words, lambda p: F.arrays_overlap(p["words"], anchors))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in every whole text, paragraph by paragraph.

    A paragraph ends at a blank line, at the end of a line that ends a sentence, and before a line that opens a notice
    (:data:`PARAGRAPH`). Returns ``id_col``, n_paragraphs (with more than white space), n_notices (of a known family, confirmed by a
    template), n_unconfirmed (of a known family without an agreeing template), families (of the confirmed,
    sorted and comma-joined), best (greatest probability among the confirmed, 0 without) and notices
    (paragraph, from 0, family, probability, agreement, confirmed). A paragraph is of a family if that is the likeliest
    class and its probability at least ``SURE``; of equally likely classes the first counts. Agreement is the greatest share of its
    trigrams found in one template, or of a template's found in it. Null and empty texts have no
    paragraphs; one row for each input row; null and repeated ids are kept as they stand; other
    columns are ignored.
    """
    m = model or train()
    k = len(m.families)
    buckets: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
    for g, w in m.weights.items():
        buckets[zlib.crc32(g.encode()) % BUCKETS][g] = w
    weights, bias = _literal(buckets, "array<map<string,array<double>>>"), _literal(m.bias, "array<double>")
    weight = lambda g: F.try_element_at(weights[(F.crc32(g.cast("binary")) % BUCKETS).cast("int")], g)
    families, templates = _literal(m.families, "array<string>"), _literal(m.templates, "array<array<array<string>>>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.size(_split(text)).cast("bigint").alias("n_paragraphs"),
        _paragraphs(text, _literal(m.anchors, "array<string>")).alias("parts"),
    )

    def judge(p: Column) -> Column:
        z = F.aggregate(_grams(p["words"]), bias, lambda acc, g: F.coalesce(F.zip_with(acc, weight(g), lambda a, b: a + b), acc))
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), z.alias("z"))

    def probability(p: Column) -> Column:
        top = F.array_max(p["z"])
        total = F.aggregate(p["z"], F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / m.temperature))
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), F.array_position(p["z"], top).cast("int").alias("k"), (1 / total).alias("probability"))

    def agreement(p: Column) -> Column:
        mine = _trigrams(p["words"])
        shares = F.transform(F.element_at(templates, p["k"]), lambda t: F.size(F.array_intersect(mine, t)) / F.least(F.size(mine), F.size(t)))
        return F.struct(p["paragraph"].alias("paragraph"), F.element_at(families, p["k"]).alias("family"), p["probability"].alias("probability"), F.array_max(shares).alias("agreement"), (F.array_max(shares) >= AGREE).alias("confirmed"))

    scored = base.withColumn("parts", F.transform("parts", judge)).withColumn("parts", F.filter(F.transform("parts", probability), lambda p: (p["k"] < k) & (p["probability"] >= SURE)))
    out = scored.withColumn("notices", F.transform("parts", agreement))
    sure = F.filter("notices", lambda n: n["confirmed"])
    out = out.withColumn("sure", sure)
    return out.select(
        F.col("id").alias(id_col),
        "n_paragraphs",
        F.size("sure").cast("bigint").alias("n_notices"),
        (F.size("notices") - F.size("sure")).cast("bigint").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda n: n["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform("sure", lambda n: n["probability"])), F.lit(0.0)).alias("best"),
        "notices",
    )
