"""Benchmark decontamination on a positional inverted index sharded by document.

The index is a table of segments. A segment holds the documents of one batch: for each
term its ascending word positions, counted through the segment. Queries run inside a
segment: the postings of a window's rarest term there, shifted by the term's offset, are
intersected with those of the next rarest, and so on through the window. Nothing is
dealt out by term, so a frequent word is never gathered anywhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from feedspark.llm.shared import prepare, tidy, written
from feedspark.llm.shingles import IS_ALNUM_WORD, word_hashes

#: Words of benchmark items that are matched in one pass; a larger benchmark is taken in several.
PASS_WORDS = 300_000
#: A segment is closed at so many words or documents.
SEGMENT_WORDS = 400_000
SEGMENT_DOCS = 4096
_SEGMENT = "segment string, doc_ids array<{id}>, lengths binary, terms binary, counts binary, positions binary"


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    return word_hashes(text.encode("utf-8", "surrogatepass"), IS_ALNUM_WORD)[0] if text else np.empty(0, np.uint64)


class Queries:
    """The different windows of a group of items, and which items hold each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        rows: dict[bytes, int] = {}
        self.windows: list[np.ndarray] = []
        self.holders: list[list[int]] = []
        self.names = [str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            size = min(window, len(w))
            for at in range(len(w) - size + 1 if size else 0):
                x = w[at : at + size]
                n = rows.setdefault(x.tobytes(), len(rows))
                if n == len(self.windows):
                    self.windows.append(x)
                    self.holders.append([])
                if not self.holders[n] or self.holders[n][-1] != k:
                    self.holders[n].append(k)
        self.terms = np.unique(np.concatenate(self.windows)) if self.windows else np.empty(0, np.uint64)
        longest = max(map(len, self.windows), default=0)
        self.sizes = np.array([len(x) for x in self.windows], dtype=np.int64)
        #: Term number at each offset of each window; -1 beyond its end.
        self.matrix = np.full((len(self.windows), longest), -1, dtype=np.int64)
        for n, x in enumerate(self.windows):
            self.matrix[n, : len(x)] = np.searchsorted(self.terms, x)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted_values, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == x


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of a positional index over whole texts.

    ``terms`` (sorted word hashes) restricts the postings to words that can take part
    in a match; None keeps all. A null text has no words. A segment is bounded by
    ``SEGMENT_WORDS`` plus one document.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    shared = spark.sparkContext.broadcast(terms)
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        # Most words are ruled out by their low bits before the search among the terms.
        gate = None
        if keep is not None:
            gate = np.zeros(1 << 20, bool)
            gate[(keep & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        ids, lengths, hashes, places, base = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            p = np.concatenate(places) if places else np.empty(0, np.int32)
            order = np.argsort(h, kind="stable")
            h, p = h[order], p[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            counts = np.diff(np.r_[first, len(h)]).astype(np.int64)
            blobs = [np.array(lengths, np.int64).tobytes(), h[first].tobytes(), counts.tobytes(), p.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(arrow_kind)), *(pa.array([x], pa.binary()) for x in blobs)], names=["segment", "doc_ids", "lengths", "terms", "counts", "positions"])

        for b in batches:
            for pid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = words_of(text.as_py())
                n = len(h)
                if keep is not None:
                    at = np.flatnonzero(gate[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    at = at[_member(keep, h[at])[1]]
                    h = h[at]
                else:
                    at = np.arange(n)
                ids.append(pid)
                lengths.append(n)
                hashes.append(h)
                places.append((at + base).astype(np.int32))
                base += n
                if base >= SEGMENT_WORDS or len(ids) >= SEGMENT_DOCS:
                    yield out()
                    ids, lengths, hashes, places, base = [], [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), _SEGMENT.format(id=kind.simpleString()))


class Segment:
    def __init__(self, ids: list, lengths: bytes, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.ids = ids
        self.lengths = np.frombuffer(lengths, np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.r_[0, np.cumsum(np.frombuffer(counts, np.int64))]
        self.positions = np.frombuffer(positions, np.int32)

    def postings(self, k: int) -> np.ndarray:
        return self.positions[self.ends[k] : self.ends[k + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase; terms are this segment's numbers of its words."""
        df = self.ends[terms + 1] - self.ends[terms]
        found = None
        for o in np.argsort(df, kind="stable"):
            p = self.postings(int(terms[o]))
            if found is None:
                found = p.astype(np.int64) - int(o)
            else:
                found = found[_member(p, found + int(o))[1]]
            if not len(found):
                return found
        doc = np.searchsorted(self.starts, found, "right") - 1
        fits = (found >= 0) & (doc < len(self.ids))
        found, doc = found[fits], doc[fits]
        return found[found + len(terms) <= self.starts[doc + 1]]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first term that have every other term of the same document within ``slop`` words, the rarest looked for first."""
        df = self.ends[terms + 1] - self.ends[terms]
        found = self.postings(int(terms[0])).astype(np.int64)
        for o in np.argsort(df, kind="stable"):
            if not len(found):
                break
            p = self.postings(int(terms[o])).astype(np.int64)
            doc = np.searchsorted(self.starts, found, "right") - 1
            low, high = np.maximum(found - slop, self.starts[doc]), np.minimum(found + slop, self.starts[doc + 1] - 1)
            found = found[np.searchsorted(p, low) < np.searchsorted(p, high, "right")]
        return found

    def numbers(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """This segment's numbers of term hashes; whether it has them."""
        return _member(self.terms, terms)


def _search(index: DataFrame, queries: list[tuple[str, str]], find, column: str) -> DataFrame:
    """Rows (id, query, ``column``) of what ``find(segment, terms)`` finds for each query of known words."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast([(name, words_of(text)) for name, text in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(n) for n in ("doc_ids", "lengths", "terms", "counts", "positions")), strict=True):
                seg = Segment(*(x.as_py() for x in row))
                docs, names, places = [], [], []
                for name, words in shared.value:
                    terms, there = seg.numbers(words)
                    if not len(words) or not there.all():
                        continue
                    found = find(seg, terms)
                    doc = np.searchsorted(seg.starts, found, "right") - 1
                    docs += [seg.ids[d] for d in doc.tolist()]
                    names += [name] * len(found)
                    places += (found - seg.starts[doc]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_ids").type.value_type), pa.array(names, pa.string()), pa.array(places, pa.int64())], names=["id", "query", column])

    return index.mapInArrow(tidy(run), f"id {kind}, query string, {column} bigint")


def find_phrases(index: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """Exact phrase matches of ``queries`` (name, text) in an index of :func:`build_index` that keeps all terms: a row
    (id, query, start) for each occurrence, with the number of its first word in the document. A query without words matches nothing."""
    return _search(index, queries, lambda seg, terms: seg.phrase(terms), "start")


def find_near(index: DataFrame, queries: list[tuple[str, str]], slop: int) -> DataFrame:
    """Proximity matches of ``queries`` (name, text): a row (id, query, at) for each place of a query's first word in a document that has
    all its other words within ``slop`` words, before or after it, in any order; a word asked for twice counts once."""
    return _search(index, queries, lambda seg, terms: seg.near(terms, slop), "at")


def match_windows(seg: Segment, q: Queries) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """For each document of a segment: the word spans of occurring windows, and the items that hold them."""
    spans: list[list[tuple[int, int]]] = [[] for _ in seg.ids]
    items: list[set[int]] = [set() for _ in seg.ids]
    if len(q.windows):
        at, there = seg.numbers(q.terms)
        has = np.r_[there, True]  # the last stands for offsets beyond a window's end
        for n in np.flatnonzero(has[q.matrix].all(axis=1)):
            size = int(q.sizes[n])
            found = seg.phrase(at[q.matrix[n, :size]])
            for p, d in zip(found.tolist(), (np.searchsorted(seg.starts, found, "right") - 1).tolist(), strict=True):
                s = p - int(seg.starts[d])
                spans[d].append((s, s + size))
                items[d].update(q.holders[n])
    return spans, items


def _covered(spans: list[tuple[int, int]]) -> int:
    n, end = 0, -1
    for s, e in sorted(spans):
        n += max(0, e - max(s, end))
        end = max(end, e)
    return n


def _summary(length: int, spans: list[tuple[int, int]], names: set[str] | list[str], share: int) -> tuple:
    hit, names = _covered(spans), sorted(names)
    return length, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and share * hit >= length


_OUT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in groups of at most ``PASS_WORDS`` words and one item; the driver holds one group at a time."""
    group, words = [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        size = len(r.text or "") // 2 + 1
        if group and words + size > PASS_WORDS:
            yield group
            group, words = [], 0
        group.append((r.id, r.text))
        words += size
    if group:
        yield group


def match(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The matches themselves: a row (id, n_words, spans, items) for each document.

    spans are the word ranges start, end (end excluded) of occurring windows, one after
    the other; items the ids (as strings) of the items that hold one. A benchmark of
    more than ``PASS_WORDS`` words is matched in several passes over one index, and a
    document's passes are put together by its place there.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    index = out = None
    several = False
    groups = _passes(benchmark, item_id, item_text)
    group = next(groups, [])
    while group is not None:
        following = next(groups, None)
        q = Queries(group, window)
        several = several or following is not None
        if index is None:
            index = written(build_index(docs, None if several else q.terms, id_col, text_col), "index")
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in batches:
                for row in zip(*(c for c in b.columns), strict=True):
                    name, *rest = (x.as_py() for x in row)
                    seg = Segment(*rest)
                    spans, items = match_windows(seg, q)
                    names = [[q.names[i] for i in x] for x in items]
                    flat = [[y for s in x for y in s] for x in spans]
                    place = pa.array(range(len(seg.ids)), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(seg.ids)), place, pa.array(seg.ids, b.schema.field(1).type.value_type), pa.array(seg.lengths, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["segment", "place", "id", "n_words", "spans", "items"])

        part = index.mapInArrow(tidy(run), f"segment string, place bigint, id {kind}, n_words bigint, spans array<bigint>, items array<string>")
        out = part if out is None else out.unionByName(part)
        group = following
    if several:
        out = out.groupBy("segment", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return out.select("id", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of each whole document that lie in a window of a benchmark item.

    Words are runs of letters and digits, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or all of a shorter item. Returns ``id_col``, n_words,
    n_hit, n_items, items_sha256 (of the ids sorted as strings, comma-joined) and
    contaminated (n_hit > 0 and ``share`` * n_hit >= n_words); one row per input row.
    Null and empty texts have no words and no hits; an empty benchmark hits nothing;
    null ids are kept; repeated items count by their id, once.
    """
    m = match(docs, benchmark, window, id_col, text_col)
    kind = m.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_summary(n, [(s[i], s[i + 1]) for i in range(0, len(s), 2)], set(x), share) for n, s, x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(cols, _OUT, strict=True))], names=["id", *(n for n, _ in _OUT)])

    out = m.mapInArrow(tidy(run), f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("id", id_col)
