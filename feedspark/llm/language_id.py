"""Language identification: scripts narrow the candidates, word scores feed a Viterbi search with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.shared import prepare, small, tidy, written
from feedspark.llm.shingles import mix

#: Labelled documents that the model learns from, about, and of each language at least, about (all, if it has fewer);
#: chosen by a hash of their ids.
TRAIN_DOCS, LANG_DOCS = 12_000, 1_000
#: Log-likelihood that a change of language costs.
SWITCH = 14.0
#: Buckets of letter trigrams, and of whole words.
TRIGRAMS, WORDS = 1 << 16, 1 << 16
#: Most that one word says for or against a language.
WORD_LIMIT = 12.0
#: Characters that are scored at a time.
CHUNK_CHARS = 1 << 17

#: First code points of runs of a script (0: other or none).
_SCRIPTS = [
    (0x41, "Latin"), (0x2B0, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "Nko"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
]
_STARTS = np.array([s for s, _ in _SCRIPTS])
SCRIPTS = ["", *dict.fromkeys(n for _, n in _SCRIPTS if n)]
_NUMBER = np.array([SCRIPTS.index(n) for _, n in _SCRIPTS])


#: The bit of a mark: marks stand inside words, but a word has a letter.
MARK = 0x80


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Script number + 1 of each code point that is a letter, plus :data:`MARK` of a mark on one, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    kinds = np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x41, 0x32400)])
    found = np.flatnonzero(kinds) + 0x41
    out[found] = _NUMBER[np.searchsorted(_STARTS, found, "right") - 1] + 1
    out[np.flatnonzero(kinds == 2) + 0x41] |= MARK
    return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of texts, one after the other with gaps, and where each begins."""
    low = [x.lower() for x in texts]
    starts = np.cumsum([1, *(len(x) + 1 for x in low)])[:-1]
    return np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


class Words:
    """The words (runs of letters and marks with a letter among them) of a group of texts, and their features."""

    def __init__(self, texts: list[str]) -> None:
        points, starts = _points(texts)
        kind = letters()[points]
        inside = kind > 0
        edge = np.diff(inside.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        letter = np.r_[0, np.cumsum(inside & (kind < MARK))]
        bare = letter[self.end] == letter[self.start]
        if bare.any():  # marks alone
            for lo, hi in zip(self.start[bare].tolist(), self.end[bare].tolist(), strict=True):
                inside[lo:hi] = False
            self.start, self.end = self.start[~bare], self.end[~bare]
        self.at = np.flatnonzero(inside)
        self.text = np.searchsorted(starts, self.start, "right") - 1
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.size = self.end - self.start
        self.script = (kind[self.start] & np.uint8(MARK - 1)).astype(np.int64) - 1
        p = np.where(inside, points, np.uint32(0)).astype(np.uint64)
        tri = (p[self.at - 1] << np.uint64(42)) ^ (p[self.at] << np.uint64(21)) ^ p[self.at + 1]
        tri = mix(tri)
        self.trigram = (tri & np.uint64(TRIGRAMS - 1)).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.size)][:-1]
        self.word = np.empty(0, np.int64)
        if len(self.start):
            total = np.r_[np.uint64(0), np.cumsum(tri)]
            # The sum of a word's trigrams, each of which holds its neighbours, stands for the word.
            self.word = (mix(total[self.first + self.size] - total[self.first]) & np.uint64(WORDS - 1)).astype(np.int64)


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about ``CHUNK_CHARS`` characters, with the number of each group's first."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


class Model:
    """Log-likelihoods of trigrams and words, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, script: np.ndarray, docs: np.ndarray) -> None:
        """counts: language by bucket (trigrams, then words); script: language by script; docs: by language."""
        self.langs = langs
        parts = []
        for lo, hi in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + WORDS)):
            c = counts[:, lo:hi] + 0.3
            p = np.log(c / c.sum(axis=1, keepdims=True))
            parts.append((p - p.sum(axis=0) / max(1, len(langs))).T.astype(np.float32))
        # A word's letters and the word itself say much of the same: each counts for half.
        self.trigram, self.word = np.ascontiguousarray(parts[0]) * np.float32(0.5), np.ascontiguousarray(parts[1]) * np.float32(0.5)
        share = script / np.maximum(1, script.sum(axis=1, keepdims=True))
        self.allowed = share >= 0.01
        self.prior = np.log((docs + 1) / (docs + 1).sum()) if len(langs) else docs

    def word_scores(self, w: Words) -> np.ndarray:
        """Word by language: log-likelihood against the mean, bounded; languages of other scripts get the least."""
        s = np.add.reduceat(self.trigram[w.trigram], w.first, axis=0) + self.word[w.word]
        s = np.clip(s, -WORD_LIMIT, WORD_LIMIT).astype(np.float64)
        ok = self.allowed[:, w.script].T
        some = ok.any(axis=1)
        s[~some] = 0
        s[some] = np.where(ok[some], s[some], -WORD_LIMIT)
        return s


def viterbi(e: np.ndarray, switch: float) -> np.ndarray:
    """The best path of states over scores e (word by state), where a change costs ``switch``."""
    n, k = e.shape
    top = int(e.sum(axis=0).argmax())
    # A stay with one state is best if no run of words gains more than a change by another.
    d = np.cumsum(e - e[:, top : top + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), d])[:-1], axis=0)
    if (d - low).max() <= switch:
        return np.full(n, top, dtype=np.int64)
    rows = e.tolist()
    v = rows[0]
    back: list[list[int]] = []
    states = range(k)
    for row in rows[1:]:
        b = max(states, key=v.__getitem__)
        other = v[b] - switch
        back.append([s if v[s] >= other else b for s in states])
        v = [(v[s] if v[s] >= other else other) + row[s] for s in states]
    s = max(states, key=v.__getitem__)
    path = [s]
    for pointers in reversed(back):
        s = pointers[s]
        path.append(s)
    return np.array(path[::-1], dtype=np.int64)


def label(model: Model, texts: list[str], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; spans are (first word, end word, language)."""
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = []
    for _, group in groups(texts):
        w = Words(group)
        scores = model.word_scores(w) if len(w.start) and model.langs else None
        for i in range(len(group)):
            lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
            if lo == hi or scores is None:
                out.append(("und", 0.0, []))
                continue
            e = scores[lo:hi]
            path = viterbi(e, switch)
            held = np.bincount(path, weights=w.size[lo:hi], minlength=len(model.langs))
            best = int(held.argmax())
            own = path == best
            total = e[own].sum(axis=0) / np.sqrt(own.sum()) + 0.1 * model.prior
            p = np.exp(total - total.max())
            share = held[best] / held.sum()
            cut = np.r_[0, np.flatnonzero(np.diff(path)) + 1, hi - lo]
            spans = [(int(a), int(b), model.langs[path[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out.append((model.langs[best], float(share * p[best] / p.sum()), spans))
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """A model from about ``train_docs`` of the labelled rows of ``docs``, chosen by a hash of ``key_col``; of a rare language
    about ``LANG_DOCS`` rows, or all that there are, teach beyond its share.

    Rows with a null language or text teach nothing. Counting is distributed; the driver
    gets the sums of a fixed number of buckets for each language.
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(key_col), F.lit(3)), F.lit(1 << 30)).alias("spot"))
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    n = sum(many.values())
    if n > train_docs:
        shares = F.create_map(*[F.lit(x) for lang, m in many.items() for x in (lang, int((1 << 30) * max(train_docs / n, LANG_DOCS / m)))])
        rows = rows.where(F.col("spot") < shares[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        width = TRIGRAMS + WORDS + len(SCRIPTS) + 1
        for b in batches:
            langs, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for at, group in groups(texts):
                w = Words(group)
                of_letter = np.repeat(w.text, w.size)
                for name in set(langs[at : at + len(group)]):
                    mine = np.array([x == name for x in langs[at : at + len(group)]])
                    into = sums.setdefault(name, np.zeros(width))
                    into[-1] += mine.sum()
                    if len(w.start):
                        mw = mine[w.text]
                        into[:TRIGRAMS] += np.bincount(w.trigram[mine[of_letter]], minlength=TRIGRAMS)
                        into[TRIGRAMS : TRIGRAMS + WORDS] += np.bincount(w.word[mw], minlength=WORDS)
                        into[TRIGRAMS + WORDS : -1] += np.bincount(w.script[mw], minlength=len(SCRIPTS))
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(v[at], pa.float64())], names=["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, bucket bigint, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    table = np.zeros((len(langs), TRIGRAMS + WORDS + len(SCRIPTS) + 1))
    if langs:
        table[np.searchsorted(langs, got["lang"].to_numpy(str)), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, table[:, : TRIGRAMS + WORDS], table[:, TRIGRAMS + WORDS : -1], table[:, -1])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text, from the text alone.

    Returns ``id_col``, lang_pred (the language of the most letters; `und` for a null text or
    one without letters), score (0 to 1: the share of letters in that language's spans times
    its posterior over the words there) and spans (first word, end word, language). One row per input row; null and
    repeated ids are kept as they stand; other columns are ignored. Ties go to the language
    that sorts first. A model of no languages finds `und` everywhere.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = label(shared.value, [x or "" for x in b.column(1).to_pylist()], switch)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in found], span)],
                names=["id", "lang_pred", "score", "spans"],
            )

    return out.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.25, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a known language: not `und`, and with
    a score of at least ``least``. No row leaves its partition."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = label(shared.value, [t or "" for t in b.column(at).to_pylist()], switch)
            yield b.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
