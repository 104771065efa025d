"""Toxicity: boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.boosting import Boosted, Isotonic
from feedspark.llm.shared import prepare, tidy, written
from feedspark.llm.shingles import IS_ALNUM_WORD, IS_SPACE_WORD, mix, window_hashes, word_hashes

#: Labelled texts that the model learns from, about; chosen by a hash of their ids.
TRAIN_DOCS = 16_000
#: Words and word beginnings learned from the labels, at most; the different toxic texts that they must be in, and
#: the log-odds that they must have for sure (less ``SURE`` standard deviations).
LEARNED, LEAST_DOCS, LEAST_ODDS, SURE = 4000, 4, 2.0, 1.5
#: Parts of the labelled texts: one calibrates, the others grow the trees.
FOLDS = 5
#: Bytes of the word beginnings.
STEMS = (4, 5, 6)
#: Words within which a second-person word is near an insult, and the width of the densest stretch.
NEAR, STRETCH = 4, 40
#: Bytes of text that are turned into features at a time.
CHUNK = 1 << 18

INSULTS = (
    "idiot idiots moron morons scum trash loser losers worthless pathetic disgusting clown clowns stupid dumb ugly hateful "
    "fool fools jerk jerks liar liars vermin filth filthy garbage imbecile cretin dimwit bigot creep creeps freak freaks "
    "crap damn bastard bastards bitch asshole shit fuck fucking bullshit retard retarded pervert "
    "dummkopf arschloch idioten abschaum widerlich wertlos erbärmlich dreck müll verlierer hass blöd blöde "
    "crétin ordure minable dégoûtant perdant salaud connard merde haine débile "
    "idiota imbécil basura perdedor patético asqueroso inútil escoria payaso mierda odio estúpido tonto"
).split()
SECOND_PERSON = "you your yours yourself yourselves u ur youre du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo vosotros usted ustedes".split()

_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_JOINED = b"*.-_~^+=`'\"%#&:;,?()[]{}<>/\\"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 63]] = True
_CLASSES = [_UPPER, _LETTER, _DIGIT, _PUNCT, _MARK, IS_SPACE_WORD]

FEATURES = [
    "log_words", "insults", "insult_share", "insult_kinds", "densest_insults", "learned", "learned_share", "densest_learned", "learned_weight", "stems", "stem_share", "densest_stems", "stem_weight",
    "near_second_person", "second_person_share", "hidden", "hidden_share", "upper_share", "capital_words", "punctuation_share", "mark_share", "digit_share", "mixed_words", "repeated_letters", "mean_word", "bytes_a_word",
]


def _hash(words: list[str]) -> np.ndarray:
    return np.unique(word_hashes(" ".join(words).encode(), IS_SPACE_WORD)[0])


class Lexicon:
    """Sorted hashes with a weight for each; most words are ruled out by their low bits."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray | None = None) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = np.ones(len(hashes)) if weights is None else weights[order]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are in the lexicon, and their weights."""
        at = np.flatnonzero(self.gate[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], np.empty(0)
        k = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        ok = self.hashes[k] == words[at]
        return at[ok], self.weights[k[ok]]


def _densest(at: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text, the most of the places that lie within ``STRETCH`` words of one another."""
    out = np.zeros(n)
    if len(at):
        key = at + text * (STRETCH + 1)  # texts are set apart by more than a stretch
        many = np.searchsorted(key, key + STRETCH) - np.arange(len(key))
        np.maximum.at(out, text, many)
    return out


def stems(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words' beginnings of :data:`STEMS` bytes (of longer words only), and of the words they begin."""
    low = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    values, owners = [], []
    for k in STEMS:
        at = np.flatnonzero(e - s > k)
        v = np.full(len(at), k, dtype=np.uint64) << np.uint64(56)
        for i in range(k):
            v |= low[s[at] + i].astype(np.uint64) << np.uint64(8 * i)
        values.append(mix(v))
        owners.append(at)
    return np.concatenate(values), np.concatenate(owners)


def features(texts: list[str], insults: Lexicon, persons: Lexicon, learned: Lexicon, beginnings: Lexicon) -> np.ndarray:
    """A row of :data:`FEATURES` for each whole text."""
    n = len(texts)
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = b"\n".join(raw) + b"\n"
    starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
    buf = np.frombuffer(data, np.uint8)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts[:-1], dtype=np.int64).astype(float) if n else np.zeros(0)

    upper, letter, digit, punct, mark, solid = (per_text(c[buf]) for c in _CLASSES)
    same = np.zeros(len(buf), bool)
    same[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]]
    repeated = per_text(same)

    h, s, e = word_hashes(data, IS_ALNUM_WORD)
    owner = np.searchsorted(starts, s, "right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    bound = np.searchsorted(owner, np.arange(n + 1))
    capital = np.bincount(owner[_UPPER[buf[s]] & _UPPER[buf[e - 1]] & (e - s > 1)], minlength=n)
    mixed_run = np.diff(np.r_[0, np.cumsum(_DIGIT[buf])][np.c_[s, e]], axis=1)[:, 0]
    mixed = np.bincount(owner[(mixed_run > 0) & (mixed_run < e - s)], minlength=n)

    at, _ = insults.find(h)
    it = owner[at]
    hits = np.bincount(it, minlength=n)
    kinds = np.zeros(n)
    if len(at):
        pairs = np.unique(np.c_[it.astype(np.uint64), h[at]], axis=0)
        kinds = np.bincount(pairs[:, 0].astype(np.int64), minlength=n)
    la, lw = learned.find(h)
    lt = owner[la]
    lhits, lweight = np.bincount(lt, minlength=n), np.bincount(lt, lw, minlength=n)
    pa_, _ = persons.find(h)
    person = np.bincount(owner[pa_], minlength=n)
    sv, so = stems(buf, s, e)
    sat, sw = beginnings.find(sv)
    sa, first = np.unique(so[sat], return_index=True)  # a word counts once
    sw, st = sw[first], owner[sa]
    shits, sweight = np.bincount(st, minlength=n), np.bincount(st, sw, minlength=n)
    both = np.unique(np.r_[at, la, sa])
    near = np.zeros(n)
    if len(pa_) and len(both):
        bt = owner[both]
        low, high = np.maximum(both - NEAR, bound[bt]), np.minimum(both + NEAR, bound[bt + 1] - 1)
        near = np.bincount(bt[np.searchsorted(pa_, low) < np.searchsorted(pa_, high, "right")], minlength=n)

    # Insults written with digits, symbols or gaps in them, found only once those are undone.
    plain = data.translate(_LEET, _JOINED)
    nl = np.flatnonzero(np.frombuffer(plain, np.uint8) == 10)
    # Line ends inside texts are kept by the translation, so texts end at the same ordinals of line ends.
    ends = np.cumsum(per_text(buf == 10).astype(np.int64)) - 1
    ph, ps, _ = word_hashes(plain, IS_SPACE_WORD)
    p_owner = np.searchsorted(nl[ends], ps) if n else ps
    pat, _ = insults.find(ph)
    undone = np.bincount(p_owner[pat], minlength=n)
    hidden = np.maximum(0, undone - hits)

    w = np.maximum(1, words)
    solid1 = np.maximum(1, solid)
    return np.c_[
        np.log1p(words), hits, hits / w, kinds, _densest(at, it, n), lhits, lhits / w, _densest(la, lt, n), lweight, shits, shits / w, _densest(sa, st, n), sweight,
        near, person / w, hidden, hidden / w, upper / np.maximum(1, letter), capital / w, punct / solid1, mark / solid1, digit / solid1, mixed / w, repeated / np.maximum(1, letter), letter / w, solid / w,
    ]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK or i == len(texts) - 1:
            yield texts[at : i + 1]
            at, size = i + 1, 0


class Model:
    def __init__(self, learned: Lexicon, beginnings: Lexicon) -> None:
        self.insults, self.persons = Lexicon(_hash(INSULTS)), Lexicon(_hash(SECOND_PERSON))
        self.learned, self.beginnings = learned, beginnings
        self.trees, self.scale = Boosted(), Isotonic()

    def features(self, texts: list[str]) -> np.ndarray:
        parts = [features(x, self.insults, self.persons, self.learned, self.beginnings) for x in chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.scale.apply(self.trees.raw(self.features(texts))), 0.0, 1.0)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (y, text) with a key, the smallest hashed run of three words, and a fold that depends on the key alone: copies
    and most near copies have one key, so they never stand on both sides of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in b.column(1).to_pylist():
                s = window_hashes(word_hashes((x or "").encode("utf-8", "surrogatepass"), IS_ALNUM_WORD)[0], 3)
                keys.append(int(s.min() >> np.uint64(1)) if len(s) else -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1)], names=["y", "key", "text"])

    return rows.mapInArrow(tidy(run), "y int, key bigint, text string").withColumn("fold", F.pmod(F.xxhash64("key", F.lit(23)), F.lit(FOLDS)).cast("int"))


def _learn_words(rows: DataFrame) -> list[tuple[Lexicon, Lexicon]]:
    """Words, and beginnings of words, that stand in many more of the toxic texts than of the others (weight: log-odds).

    From ``rows`` (y, key, text, fold): first those learned from all folds but 0, then for each other fold those learned
    without it. Of the texts of a label and key one counts. Document frequencies are counted by hashes
    in parts and summed by Spark; the driver gets the ``LEARNED`` strongest of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
            for y, fold, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (x or "").encode("utf-8", "surrogatepass")
                h, s, e = word_hashes(data, IS_ALNUM_WORD)
                for kind, v in enumerate((h, stems(np.frombuffer(data, np.uint8), s, e)[0])):
                    found.setdefault((kind, fold), []).append((np.unique(v), y))
            for (kind, fold), parts in found.items():
                h, y = np.concatenate([v for v, _ in parts]), np.concatenate([np.full(len(v), y) for v, y in parts])
                u, k = np.unique(h, return_inverse=True)
                sums = [np.bincount(k, w, len(u)).astype(np.int64) for w in (y, 1 - y)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind), pa.int32()), pa.array(np.full(len(u), fold), pa.int32()), pa.array(u.view(np.int64)), *map(pa.array, sums)], names=["kind", "fold", "word", "toxic", "clean"])

    one = written(rows.where("fold > 0").groupBy("y", "key", "fold").agg(F.min("text").alias("text")).select("y", "fold", "text"), "distinct")
    totals = {r.fold: (r.t, r.n - r.t) for r in one.groupBy("fold").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    counts = one.mapInArrow(tidy(run), "kind int, fold int, word bigint, toxic bigint, clean bigint")
    own = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(1, FOLDS) for c in ("toxic", "clean")]
    counts = counts.groupBy("kind", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *own)
    counts = written(counts.where(F.col("toxic") >= LEAST_DOCS), "words")
    out = []
    for left_out in range(FOLDS):
        t, c = (sum(v[i] for f, v in totals.items() if f != left_out) for i in (0, 1))
        toxic, clean = (F.col(x) - F.col(f"{x}{left_out}") if left_out else F.col(x) for x in ("toxic", "clean"))
        odds = F.log((toxic + 0.5) / (t - toxic + 0.5)) - F.log((clean + 0.5) / (c - clean + 0.5))
        spread = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        strong = counts.where(toxic >= LEAST_DOCS).select("kind", "word", odds.alias("odds"), (odds - SURE * spread).alias("sure")).where(F.col("sure") >= LEAST_ODDS)
        got = strong.orderBy(F.desc("sure"), "kind", "word").limit(LEARNED).collect()
        out.append(tuple(Lexicon(np.array([r.word for r in got if r.kind == k], dtype=np.int64).view(np.uint64), np.array([r.odds for r in got if r.kind == k])) for k in (0, 1)))
    return out


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from about ``train_docs`` labelled texts, chosen by a hash of the id.

    A document with several labels is toxic if one of them says so; null labels and ids
    teach nothing. Four of five folds grow the trees, the rest fits the calibration. The words of a text that grows
    trees are looked up in lexicons learned without its fold, so that learned words look no better there than they will be.
    """
    prepare(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    spot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = y.join(x.select("id"), "id", "left_semi").count()
    if n > train_docs:
        y, x = (d.where(spot < int((1 << 30) * train_docs / n)) for d in (y, x))
    rows = written(_keyed(x.join(y, "id").select("y", "text")), "labelled")
    models = [Model(*words) for words in _learn_words(rows)]
    model, shared = models[0], docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds, texts = b.column(1).to_numpy(), [t or "" for t in b.column(2).to_pylist()]
            f = np.zeros((len(texts), len(FEATURES)))
            for fold in np.unique(folds).tolist():
                mine = np.flatnonzero(folds == fold)
                f[mine] = shared.value[fold].features([texts[i] for i in mine])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(f), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    got = rows.select("y", "fold", "text").mapInArrow(tidy(run), "y int, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r.fold, r.y, r.x))
    fold, label = np.array([r.fold for r in got]), np.array([r.y for r in got], dtype=float)
    matrix = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    model.trees.fit(matrix[fold > 0], label[fold > 0])
    model.scale.fit(model.trees.raw(matrix[fold == 0]), label[fold == 0])
    if not (fold == 0).any():
        model.scale.x, model.scale.y = np.linspace(-6, 6, 49), 1 / (1 + np.exp(-np.linspace(-6, 6, 49)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Calibrated toxicity of every whole text, from the text alone.

    Returns ``id_col``, score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts are
    scored as texts without words. One row per input row; null and repeated ids are kept
    as they stand; other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32())], names=["id", "score", "predicted"])

    return out.mapInArrow(tidy(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``limit``. No row leaves its partition."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score([t or "" for t in b.column(at).to_pylist()]) < limit, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
