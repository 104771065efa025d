"""MinHash near-dedup: a chosen-path similarity join, then exact links on full shingle sets.

1. Every whole text becomes its set of hashed shingles; equal sets become one node,
   kept with its minwise tokens and a sketch of them.
2. Each tree branches a node by two minwise tokens at the root and by one or two a level
   below. A branch with one member ends, a small one is compared exhaustively on sketches.
   In a large branch all members are held against one of them, the pivot. Members near it are
   proposed with it; members that nearly equal it are settled: by the triangle inequality
   of sketches, all that they can be linked with is near the pivot too. If nobody is far
   from the pivot the branch ends; if few are, they are compared with all that isn't settled;
   otherwise far members and unsettled ones branch on, until all branches have ended. All this
   proposes edges; only what connects matters, so a branch yields a spanning forest.
3. Each component of proposals is cut into blocks bounded in members and bytes, and the
   full sets of a block are compared exhaustively. In a component of several blocks some
   members stand in every block; then what is outside its largest class is compared, in
   blocks, with all the rest of a size that allows a link. So no link inside a component
   of proposals is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.components import components
from feedspark.llm.shared import prepare, small, tidy, written
from feedspark.llm.shingles import mix, shingle_set

#: Independent trees, branches of a root, and levels before the first comparison. A pair of similarity 0.85 (0.8) meets in
#: no branch that is compared there 2 (47) times in ten million.
TREES, BRANCHES, FIRST = 6, 2, 2
#: Levels at most; what is far from the pivots of large branches even then joins them.
LEVELS = 22
#: Members up to which a branch, or what is far from its pivot, is compared exhaustively.
LEAF = 64
#: Sketch: one byte of each of 64 minwise tokens. As many must agree as a pair at the limit has on average,
#: less 4.7 standard deviations: 40 of 64 at 0.85, 36 at 0.8.
SKETCH, DEVIATIONS = 64, 4.7
#: Bytes in which a settled member may differ from its pivot.
SETTLED = 8
#: Members of a branch that meet what is far from its pivot in one task at a time.
RIM = 1024
#: Bounds of a block of full sets.
BLOCK_DOCS, BLOCK_BYTES = 256, 4 << 20
#: Expected members of a component that stand in each of its blocks.
PIVOTS = 12
#: Rows up to which ids of proposed documents are broadcast; beyond, texts are joined by shuffle.
BROADCAST_IDS = 500_000
#: Pivots of large branches, with their sketches, up to which they are broadcast.
BROADCAST_PIVOTS = 200_000
#: Cells of a block's member-by-shingle matrix at a time.
CELLS = 1 << 20

_PATHS = TREES * BRANCHES
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set under each of the hash functions."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(best, (s[at : at + 4096, None] * _MULTIPLIERS).min(axis=0), out=best)
    return best


def node_of(s: np.ndarray) -> bytes:
    """128 bits that stand for a set: its size, sum and xor after different mixing."""
    a = np.add.reduce(mix(s ^ np.uint64(0x5BD1E9955BD1E995))) + np.uint64(len(s))
    b = np.bitwise_xor.reduce(mix(s + np.uint64(0x2545F4914F6CDD1D)))
    return np.array([a, b], dtype=">u8").tobytes()


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, tokens, sketch) for each row; an empty set has no node."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, tokens, sketches = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    for x in (nodes, tokens, sketches):
                        x.append(None)
                    continue
                best = minwise(s)
                nodes.append(node_of(s))
                tokens.append((best >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sketches.append((mix(best) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], names=["id", "n", "node", "tokens", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, n bigint, node binary, tokens array<int>, sketch binary")


def _first_branches() -> list[Column]:
    """(path, key) of the branches that are compared first: a root's branches, each followed by one more token a level."""
    found = []
    for path in range(_PATHS):
        key = F.lit(path // BRANCHES).cast("bigint")
        for depth in range(FIRST):
            key = F.xxhash64(key, F.col("tokens")[depth * _PATHS + path])
        found.append(F.struct(F.lit(path).alias("path"), key.alias("key")))
    return found


def _next_branches(depth: int) -> list[Column]:
    """Keys one level below ``depth``: by one token, or by two at every second level. A path takes its tokens in an order of its own."""
    used = _PATHS * FIRST
    wide = 1 + (depth - FIRST) % 2
    at = [F.pmod(F.col("path") * 7 + (depth - FIRST) * 2 + b, F.lit(SKETCH - used)) + used for b in range(wide)]
    return [F.xxhash64("key", F.col("tokens")[x]) for x in at]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1: (member, smallest of its component)."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


_EDGE = "a binary, b binary"


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"])


def agreeing(percent: int) -> int:
    """Bytes of two sketches that must agree."""
    s = percent / 100
    return int(SKETCH * s - DEVIATIONS * (SKETCH * s * (1 - s)) ** 0.5)


def _compare_leaves(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], set()
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["node"])
                key = b"".join(m["node"] for m in members)
                if key in seen:
                    continue
                seen.add(key)
                sk = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), SKETCH)
                agree = (sk[:, None, :] == sk[None, :, :]).sum(axis=2) >= least
                a, b = np.nonzero(np.triu(agree, 1))
                out += [(members[i]["node"], members[j]["node"]) for i, j in spanning(len(members), a, b)]
            yield _edges(out)

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes in which members agree with their pivots, instead of the pivots' sketches."""
    for b in batches:
        agree = (_sketches(b.column("sketch")) == _sketches(b.column("pivot_sketch"))).sum(axis=1).astype(np.int32)
        names = [n for n in b.schema.names if n != "pivot_sketch"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(agree)], names=[*names, "agree"])


def _compare_far(least: int):
    """Edges between far members and all members of their part of a branch; rows (key, part, node, sketch, far) in order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sketches, far = None, [], [], []

        def done() -> pa.RecordBatch:
            sk, mark = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), SKETCH), np.flatnonzero(far)
            agree = np.stack([(sk == sk[i]).sum(axis=1) >= least for i in mark]) if len(mark) else np.zeros((0, len(nodes)), bool)
            a, b = np.nonzero(agree)
            return _edges([(nodes[i], nodes[j]) for i, j in spanning(len(nodes), mark[a], b)])

        for batch in batches:
            for key, part, node, sketch, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != block and nodes:
                    yield done()
                    nodes, sketches, far = [], [], []
                block = (key, part)
                nodes.append(node)
                sketches.append(sketch)
                far.append(f)
        if nodes:
            yield done()

    return run


def proposals(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all nodes which meet in a tree and whose sketches agree."""
    least = agreeing(percent)
    near = least - SETTLED  # what may be linked with a settled member agrees with the pivot at least so far
    found = []
    rows = nodes.select("node", F.explode(F.array(*_first_branches())).alias("x")).select("node", "x.path", "x.key")
    for depth in range(FIRST, LEVELS + 1):
        counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1"), "counts")
        met = written(rows.join(small(counts, BROADCAST_IDS), "key"), "met")
        leaves = met.where(F.col("size") <= LEAF).select("key", "node").join(nodes.select("node", "sketch"), "node")
        leaves = leaves.groupBy("key").agg(F.collect_list(F.struct("node", "sketch")).alias("members")).select("members")
        found.append(leaves.mapInArrow(tidy(_compare_leaves(least)), _EDGE))
        large = counts.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        pivots = written(large.select("key", F.col("pivot").alias("node")).join(nodes.select("node", F.col("sketch").alias("pivot_sketch")), "node").select("key", "pivot_sketch"), "pivots")
        big = met.where(F.col("size") > LEAF).join(nodes.select("node", "sketch"), "node").join(small(pivots, BROADCAST_PIVOTS), "key")
        big = big.select("key", "node", "path", "size", "pivot", "sketch", "pivot_sketch")
        judged = written(big.mapInArrow(tidy(_judge), "key bigint, node binary, path int, size bigint, pivot binary, sketch binary, agree int"), "judged")
        found.append(judged.where((F.col("agree") >= near) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        fars = written(judged.where(F.col("agree") < near).groupBy("key").agg(F.count(F.lit(1)).alias("n_far")), "fars")
        if fars.isEmpty():
            break
        unsettled = written(judged.where(F.col("agree") < SKETCH - SETTLED).join(small(fars, BROADCAST_IDS), "key"), "unsettled")
        parts = F.ceil(F.col("size") / RIM).cast("bigint")
        far = F.col("agree") < near
        part = F.when(far, F.sequence(F.lit(0).cast("bigint"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts)))
        few = unsettled.where(F.col("n_far") <= LEAF).select("key", F.explode(part).alias("part"), "node", "sketch", far.alias("far"))
        found.append(few.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(tidy(_compare_far(least)), _EDGE))
        on = unsettled.where(F.col("n_far") > LEAF)
        if depth == LEVELS:
            found.append(on.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
            break
        if on.isEmpty():
            break
        on = on.select("key", "node", "path").join(nodes.select("node", "tokens"), "node")
        rows = written(on.select("node", "path", F.explode(F.array(*_next_branches(depth))).alias("key")), "branches")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def links_within(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with 100 * intersection >= percent * union, counted exactly.

    ``left``: only pairs of one that is marked and one that isn't.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = np.zeros((m, m), dtype=np.int64)
    if m > 1:
        row = np.repeat(np.arange(m), size)
        flat = np.concatenate(sets)
        values, where = np.unique(flat, return_inverse=True)
        twice = np.bincount(where, minlength=len(values)) > 1
        number = np.cumsum(twice) - 1
        keep = twice[where]
        row, col = row[keep], number[where[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        columns = int(twice.sum())
        step = max(1, min(CELLS // m, columns))
        for at in range(0, columns, step):
            lo, hi = np.searchsorted(col, (at, at + step))
            part = np.zeros((m, step), dtype=np.float32)
            part[row[lo:hi], col[lo:hi] - at] = 1
            common += np.rint(part @ part.T).astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    return np.nonzero(np.triu(linked, 1))


def _compare_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sets, side = None, [], [], []

        def done() -> pa.RecordBatch:
            marks = np.array(side, dtype=np.int64)
            a, b = links_within(sets, percent, marks if marks.any() else None)
            return _edges([(nodes[i], nodes[j]) for i, j in spanning(len(nodes), a, b)])

        for batch in batches:
            for k, node, s, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block and nodes:
                    yield done()
                    nodes, sets, side = [], [], []
                if k == block and nodes and (nodes[-1], side[-1]) == (node, v):
                    continue  # from a row that repeats an id
                block = k
                nodes.append(node)
                sets.append(np.frombuffer(s, np.uint64))
                side.append(v)
        if nodes:
            yield done()

    return run


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the ``members`` (block, node, side) of each block."""
    rows = sets.join(small(members, BROADCAST_IDS), "node").select("block", "node", "set", "side")
    return rows.repartition("block").sortWithinPartitions("block", "side", "node").mapInArrow(tidy(_compare_blocks(percent)), _EDGE)


def _second_blocks(several: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Blocks (block, node, side) for the rest of large components, from their members (node, label, n) and the classes found
    so far (node, label).

    What is outside a component's largest class stands on side 1, and all members on side 0; pairs across are
    compared. Sizes are split in steps of a little more than the threshold, and only steps that allow a link meet.
    """
    step = F.floor(F.log("n") / (1.001 * float(np.log(100 / percent)))).cast("bigint")
    now = several.join(found.select("node", F.col("label").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    now = written(now.withColumn("step", step), "classes")
    main = now.groupBy("label", "class").agg(F.count(F.lit(1)).alias("k")).groupBy("label").agg(F.max_by("class", F.struct("k", "class")).alias("main"))
    outside = F.col("class") != F.col("main")
    now = written(now.join(main, "label").withColumn("outside", outside), "compared")
    sizes = now.groupBy("label", "step").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, 8 * F.sum("n") / BLOCK_BYTES)).cast("bigint").alias("parts"), F.ceil(F.greatest(F.count_if("outside") / BLOCK_DOCS, 8 * F.sum(F.when(F.col("outside"), F.col("n"))) / BLOCK_BYTES)).cast("bigint").alias("rests"))
    sizes = written(sizes.select("label", "step", "parts", F.coalesce("rests", F.lit(0)).alias("rests")), "sizes")
    # Each step of sizes with those of its component that it may be linked with.
    meet = sizes.select("label", F.col("step").alias("of"), F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"), F.col("rests").alias("rests_of")).where("rests_of > 0")
    meet = written(meet.join(sizes.select("label", "step", "parts"), ["label", "step"]).select("label", "step", "parts", "of", "rests_of"), "meet")
    spot = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    block = F.concat_ws("/", F.hex("label"), "step", "part", "of", "rest").alias("block")
    pairs = small(meet, BROADCAST_IDS)
    ones = now.where("outside").withColumnRenamed("step", "of").join(pairs, ["label", "of"]).withColumn("rest", spot(5, "rests_of")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    zeros = now.join(pairs, ["label", "step"]).withColumn("part", spot(3, "parts")).withColumn("rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rests_of") - 1)))
    return ones.select(block, "node", F.lit(1).alias("side")).unionByName(zeros.select(block, "node", F.lit(0).alias("side")))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near-duplicates of every row.

    A text's set is its distinct ``words``-word shingles over whitespace-separated words,
    A-Z lower-cased; fewer words make one shingle. Sets are linked from
    ``percent`` % of their union in common. Returns ``id_col``, n_shingles, component_id (smallest
    id reachable over links, its own included) and kept (id = component_id).
    Texts that are null, empty or white space have the empty set and are linked with
    nothing. Rows of a null id are linked with nothing, with component_id null and kept true.
    Repeated rows share a component; rows that repeat an id are all kept or all not.
    An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    sig = written(signatures(docs, words, id_col, text_col), "signatures")
    usable = sig.where("node IS NOT NULL AND id IS NOT NULL")
    nodes = written(usable.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "nodes")
    proposed = written(components(proposals(nodes, percent)).join(nodes.select("node", "least", "n"), "node"), "proposed")

    # Full sets of the proposed nodes, from one text each.
    wanted = proposed.select("least").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(small(wanted.withColumnRenamed("least", "id"), BROADCAST_IDS), "id", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x.as_py(), words) for x in b.column(1)]
            found = [s for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "set"])

    sets = written(texts.mapInArrow(tidy(full), "node binary, set binary").join(small(proposed.select("node"), BROADCAST_IDS), "node", "left_semi"), "sets")

    size = proposed.groupBy("label").agg(F.count(F.lit(1)).alias("members"), (8 * F.sum("n")).alias("bytes"))
    size = size.select("label", F.greatest(F.ceil(F.col("members") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("bigint").alias("blocks"), "members")
    spot = F.xxhash64("node", F.lit(11))
    placed = written(
        proposed.join(size, "label").select("node", "label", "n", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("part"), (F.pmod(spot, F.lit(1 << 20)) < PIVOTS * (1 << 20) / F.col("members")).alias("pivot")),
        "placed",
    )
    everywhere = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array("part"))
    blocks = F.concat_ws("/", F.hex("label"), "part").alias("block")
    first = placed.select("node", "label", "blocks", F.explode(everywhere).alias("part")).select(blocks, "node", F.lit(0).alias("side"))
    links = written(_in_blocks(written(first, "first"), sets, percent), "links")
    # In a component of one block each link already leads to the smallest of its class.
    several = placed.where("blocks > 1").select("node", "label", "n")
    classes = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if several.take(1):
        several = written(several, "several")
        inside = small(several.select(F.col("node").alias("a")), BROADCAST_IDS)
        classes, partial = classes.join(inside, F.col("a") == F.col("node"), "left_anti"), written(links.join(inside, "a", "left_semi"), "partial")
        more = _in_blocks(written(_second_blocks(several, components(partial), percent), "second"), sets, percent)
        classes = classes.unionByName(components(partial.unionByName(more)))
    classes = written(classes.unionByName(classes.select(F.col("label").alias("node"), "label")).distinct(), "classes")
    least = classes.join(nodes.select("node", "least"), "node")
    least = least.groupBy("label").agg(F.min("least").alias("component"))
    of_node = classes.join(least, "label").select("node", "component")
    own = written(nodes.select("node", "least").join(of_node, "node", "left").select("node", F.coalesce("component", "least").alias("component")), "own")
    # Hot nodes (thousands of equal texts) are on the left of a join of two plain exchanges, which Spark can split.
    out = sig.select("id", "n", "node").join(own, "node", "left")
    component = F.when(F.col("node").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
