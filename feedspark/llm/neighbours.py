"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt by a hash of their id into shards bounded in rows and bytes. A shard has a
forest: for each tree the hash strings of its vectors as a sorted array of integers, and the vectors'
places in that order. A character of a string says along which of up to 64 random orthogonal
directions a vector lies most, and on which side. A query descends in all trees of a shard to
its longest matching prefixes, then ascends in all trees, one bit at a time, until enough
candidates stand under the prefixes; in the last step only as many trees ascend as are needed. How many
are enough grows less than the shard (see :data:`ENOUGH`). Candidates are scored exactly; the best
of all shards are ranked. The index holds every vector; queries meet it in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark.llm.shared import prepare, tidy, written

TREES = 64
#: Vectors and bytes of a shard, about.
SHARD_ROWS, SHARD_BYTES = 32_768, 16 << 20
#: The ascent ends once LEAST + ENOUGH * rows ** POWER candidates of the shard, repeats counted, stand under the prefixes.
LEAST, ENOUGH, POWER = 600, 6.5, 0.7
#: Queries that travel together, and tasks at most that share the queries of a shard.
BLOCK, GROUPS = 256, 8
#: Directions of a character, at most, and bits of a string, at least.
WIDTH, LEAST_BITS = 64, 21


def shape(dim: int) -> tuple[int, int, int]:
    """(characters of a string, directions of a character, bits of a character) for vectors of a length."""
    bits = min(WIDTH, dim + 1).bit_length() - 1
    return -(-LEAST_BITS // (bits + 1)), 1 << bits, bits + 1


def directions(dim: int) -> np.ndarray:
    """Random directions of all trees (tree by dim + 1 by direction); those of one character are orthogonal."""
    rng = np.random.default_rng(dim)
    many, width, _ = shape(dim)
    out = np.empty((TREES, dim + 1, many * width), dtype=np.float32)
    for t in range(TREES):
        out[t] = np.concatenate([np.linalg.qr(rng.normal(size=(dim + 1, width)))[0] for _ in range(many)], axis=1)
    return out


def codes(x: np.ndarray, ways: np.ndarray, dim: int) -> np.ndarray:
    """Hash strings (tree by row) as integers, first character highest."""
    many, width, bits = shape(dim)
    x = x.astype(np.float32)
    out = np.zeros((len(ways), len(x)), dtype=np.uint64)
    step = max(1, (1 << 20) // width)
    for t, w in enumerate(ways):
        for at in range(0, len(x), step):
            part, rows = out[t, at : at + step], np.arange(len(x[at : at + step]))
            for k in range(many):
                along = x[at : at + step] @ w[:, k * width : (k + 1) * width]
                most = np.abs(along).argmax(axis=1)
                part[:] = (part << np.uint64(bits)) | (most.astype(np.uint64) << np.uint64(1)) | (along[rows, most] > 0)
    return out


class Forest:
    """Sorted hash strings of the different vectors of one shard.

    ``x`` has each vector once; the ids of equal vectors, ascending, are ``ids[starts[i] : starts[i + 1]]``, so that
    however many copies a vector has, they take the room of one among the candidates.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, x: np.ndarray, sorted_codes: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.starts, self.x, self.sorted, self.order = ids, starts, x, sorted_codes, order
        self.ways = directions(x.shape[1])
        many, _, bits = shape(x.shape[1])
        self.bits = many * bits

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Forest:
        """Vectors get one more component that makes them of one length, so that the nearest direction is the largest product."""
        dim = x.shape[1]
        _, first, which = np.unique(np.ascontiguousarray(x).view(f"V{8 * dim}")[:, 0], return_index=True, return_inverse=True)
        by = np.lexsort((ids, which))
        ids, starts, x = ids[by], np.r_[0, np.cumsum(np.bincount(which))], x[first]
        most = float(np.abs(x).max())
        y = x / most  # squares of components near the limit of doubles stay finite
        norm = np.sqrt((y * y).sum(axis=1))
        scale = float(norm.max())
        rest = np.sqrt(np.maximum(0.0, 1 - (norm / scale) ** 2))
        c = codes(np.c_[y / scale, rest], directions(dim), dim)
        order = np.argsort(c, axis=1, kind="stable").astype(np.int32)
        return cls(ids, starts, x, np.take_along_axis(c, order.astype(np.int64), axis=1), order)

    def ranges(self, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where strings that share their first ``level`` bits with a query begin and end (all tree by query)."""
        below = (np.uint64(1) << (self.bits - level).astype(np.uint64)) - np.uint64(1)
        lo, hi = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
        for t, s in enumerate(self.sorted):
            lo[t] = np.searchsorted(s, q[t] & ~below[t])
            hi[t] = np.searchsorted(s, q[t] | below[t], "right")
        return lo, hi

    def levels(self, q: np.ndarray) -> np.ndarray:
        """To which prefixes a query ascends in each tree (tree by query)."""
        wanted = min(len(self.x) * TREES, LEAST + ENOUGH * len(self.x) ** POWER)
        count = lambda level: np.subtract(*self.ranges(q, np.broadcast_to(level, q.shape))[::-1])
        # The deepest level at which all trees together hold enough; counts only shrink with depth.
        low, high = np.zeros(q.shape[1], np.int64), np.full(q.shape[1], self.bits, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = count(mid).sum(axis=0) >= wanted
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        deeper = np.minimum(low + 1, self.bits)
        here, below = count(low), count(deeper)
        held = below.sum(axis=0) + np.cumsum(here - below, axis=0)
        before = np.vstack([below.sum(axis=0), held[:-1]])
        return np.where(before < wanted, low, deeper)

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """Places of each query's candidates; all places where fewer than ``least`` are found."""
        longest = np.maximum(np.abs(queries).max(axis=1, keepdims=True), 1e-300)
        unit = queries / longest
        unit /= np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-300)
        q = codes(np.c_[unit, np.zeros(len(queries))], self.ways, queries.shape[1])
        lo, hi = self.ranges(q, self.levels(q))
        for i in range(len(queries)):
            seen = np.zeros(len(self.x), dtype=bool)
            for t in range(TREES):
                seen[self.order[t, lo[t, i] : hi[t, i]]] = True
            found = np.flatnonzero(seen)
            yield found if len(found) >= least else np.arange(len(self.x))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's id, ids, scores) of its best k in this shard, largest product first, ties to smaller ids."""
        for qid, q, c in zip(qids.tolist(), queries, self.candidates(queries, k + 1), strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.x[c] @ q
                if len(c) > k + 1 and np.isfinite(rough).all():  # one of the best may be the query itself
                    edge = np.partition(rough, len(c) - k - 1)[len(c) - k - 1]
                    c = c[rough >= edge - 1e-9 * max(1.0, abs(edge))]
                # Row by row, so that equal vectors get equal scores.
                s = (self.x[c] * q).sum(axis=1)
            many = np.minimum(self.starts[c + 1] - self.starts[c], k + 1)
            at = np.repeat(self.starts[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ids, s = self.ids[at], np.repeat(s, many)
            ids, s = ids[ids != qid], s[ids != qid]
            best = np.lexsort((ids, np.where(np.isnan(s), np.inf, -s)))[:k]
            yield qid, ids[best], s[best]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; an id that is repeated counts once, with its smallest vector."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False))).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(v).alias("v"))


def _vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


_INDEX = "dim int, shard bigint, ids binary, starts binary, vectors binary, codes binary, places binary"


def build_index(vs: DataFrame) -> DataFrame:
    """One row for each shard, from (id, v, dim, shards): every vector is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []

        def out() -> pa.RecordBatch:
            f = Forest.build(np.concatenate(ids), np.concatenate(xs))
            row = [key[0], key[1], f.ids.tobytes(), f.starts.astype(np.int64).tobytes(), f.x.tobytes(), f.sorted.tobytes(), f.order.tobytes()]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["dim", "shard", "ids", "starts", "vectors", "codes", "places"])

        for b in batches:
            dims, shards, bids = (b.column(k).to_numpy() for k in range(3))
            cuts = np.r_[0, np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0)) + 1, len(dims)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                now = (int(dims[lo]), int(shards[lo]))
                if key is not None and now != key:
                    yield out()
                    ids, xs = [], []
                key = now
                ids.append(np.array(bids[lo:hi], np.int64))
                xs.append(_vectors_of(b.column(3).slice(lo, hi - lo), now[0]))
        if ids:
            yield out()

    dealt = vs.select("dim", F.pmod(F.xxhash64("id"), "shards").alias("shard"), "id", "v")
    return dealt.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "id").mapInArrow(tidy(run), _INDEX)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (dim, shards, groups, id, v) of a batch as blocks of one dimension."""
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            where = np.flatnonzero(dims == dim)
            for at in range(0, len(where), BLOCK):
                part = b.take(pa.array(where[at : at + BLOCK]))
                row = [dim, part.column(1)[0].as_py(), part.column(2)[0].as_py(), part.column(3).to_numpy().astype(np.int64).tobytes(), _vectors_of(part.column(4), dim).tobytes()]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["dim", "shards", "groups", "ids", "vectors"])


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each row for which the Column ``is_query`` holds, against all other rows.

    Nearness is the largest inner product, in double precision. Returns query_id, rank (from 1),
    vec_id and score, ties to the smaller id; fewer rows where there are fewer candidates.
    Null and zero vectors, and those with null or non-finite components, take no part, as
    queries or as candidates, and rows with a null id neither; rows that share an id
    count once; vectors meet only those of their own length. Where products overflow, those that aren't numbers
    come last. No row gives no rows.
    """
    spark = prepare(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    vs = vectors(df, id_col, vector_col).withColumn("dim", F.size("v"))
    vs = written(vs, "vectors")
    rows = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    groups = F.greatest(F.lit(1), F.least(F.lit(GROUPS), F.ceil(F.count_if(is_query(F.col("id"))) / (4 * BLOCK))))
    shards = vs.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), groups.cast("bigint").alias("groups")).select("dim", "groups", F.ceil(F.col("n") / rows).cast("bigint").alias("shards"))
    vs = vs.join(F.broadcast(shards), "dim")  # a row for each length of vector
    index = written(build_index(vs), "forest")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    queries = vs.where(is_query(F.col("id"))).select("dim", "shards", "groups", "id", "v").mapInArrow(tidy(_blocks), "dim int, shards bigint, groups bigint, ids binary, vectors binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("starts", "codes", "places")]
    queries = queries.select("dim", upto("shards").alias("shard"), F.pmod(F.xxhash64("ids"), "groups").alias("group"), F.lit(1).alias("kind"), "ids", "vectors", *none)
    meet = index.join(F.broadcast(shards.select("dim", "groups")), "dim").withColumn("group", upto("groups")).withColumn("kind", F.lit(0)).select(*queries.columns).unionByName(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for b in batches:
            for i in range(b.num_rows):
                dim, _, _, kind, ids, xs, starts, sorted_codes, places = (c[i].as_py() for c in b.columns)
                ids = np.frombuffer(ids, np.int64)
                xs = np.frombuffer(xs, np.float64).reshape(-1, dim)
                if kind == 0:
                    forest = Forest(ids, np.frombuffer(starts, np.int64), xs, np.frombuffer(sorted_codes, np.uint64).reshape(TREES, -1), np.frombuffer(places, np.int32).reshape(TREES, -1))
                    continue
                found = list(forest.search(ids, xs, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in found], [len(c) for _, c, _ in found]).astype(np.int64)), pa.array(np.concatenate([c for _, c, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    hits = meet.repartition("dim", "shard", "group").sortWithinPartitions("dim", "shard", "group", "kind").mapInArrow(tidy(run), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
