"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone.

1. Each source's target: its weight's share of the tokens asked for, at most ``cap`` times its
   size, the excess shared again by weight (one water level over sources in order of size to weight).
2. Rates: of all rates between 0 and ``cap`` that give a source its target, those nearest to
   one copy of each document in relative entropy. They are min(cap, exp(lambda * size / mean size));
   a safeguarded Newton iteration on each source's dual finds lambda, all sources at once,
   over the counts of documents by source and size; a job takes several steps.
3. Copies: floor(rate + u + shift) with u from a hash of the id. A document's k-th copy begins at the shift
   k - rate - u, so a source's shift is a weighted quantile of these: histograms of their words, each
   over the bin that the one before found, come nearest to the target, and a few single
   documents then change by one copy where that comes nearer still.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.llm.shared import small, written

#: Weights of the sources by their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Tokens asked for, against all tokens; most copies of a document.
SHARE, CAP = 1.5, 2
#: Newton steps at most, and of a job; relative error of tokens at which they end.
ROUNDS, STEPS, CLOSE = 60, 5, 1e-9
#: Histograms of the search for the shift, their bins, and rounds of single changes; error at which they end.
SHIFTS, BINS, CHANGES, NEAR = 3, 4096, 4, 1e-5
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class MixPlan:
    """sources: source, source_size, target, lam, mean, shift; changes: source, size, u, by (of single documents)."""

    sources: DataFrame
    changes: DataFrame


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("bigint")


def _spot(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def measures(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, Column]:
    """What a row needs to be mixed: source, size and u, a number that depends on its id."""
    return {"source": F.col(source_col).cast("string"), "size": _size(F.col(text_col)), "u": _spot(F.col(id_col))}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, u) of each row."""
    return docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in measures(id_col, text_col, source_col).items()])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row for each source.

    Only this table of sources goes through windows of one task; documents never do.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    parts = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", parts[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")])
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("asked", F.sum("source_size").over(every) * share)
    levels = levels.withColumn("level", (F.col("asked") - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The sources below the first one whose limit holds the water are full.
    holds = F.when(cap * F.col("source_size") / F.col("weight") >= F.col("level"), F.struct(F.col("source_size") / F.col("weight"), "level"))
    levels = levels.withColumn("water", F.min(holds).over(every)["level"])
    full = (cap * F.col("source_size")).cast("double")
    return levels.select("source", "source_size", "weight", F.least(F.coalesce(F.col("weight") * F.col("water"), full), full).alias("target"))


def _join_source(left: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    right = sources.withColumnRenamed("source", "of_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def _tilt(size: Column, lam: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), lam * size / mean)))


def _newton(state: DataFrame, cells: DataFrame, cap: float, few: bool) -> DataFrame:
    """One step for all sources that aren't done."""
    rate = _tilt(F.col("size"), F.col("lam"), F.col("mean"), cap)
    x, tokens = F.col("size") / F.col("mean"), F.col("n") * F.col("size")
    # Decimals add up to the same sum in any order, so reruns agree.
    exact = lambda c: F.sum(F.when(F.col("done"), 0.0).otherwise(c).cast("decimal(30,8)")).cast("double")
    kept = F.first(F.struct(*[F.col(c) for c in state.columns if c != "source"])).alias("s")
    rows = _join_source(cells, F.broadcast(state) if few else state)
    now = rows.groupBy("source").agg(kept, exact(tokens * rate).alias("f"), exact(F.when(rate < cap, tokens * x * rate).otherwise(0.0)).alias("d")).select("source", "s.*", "f", "d")
    below = F.col("f") < F.col("target")
    now = now.withColumns({"lo": F.when(below & ~F.col("done"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(~below & ~F.col("done"), F.col("lam")).otherwise(F.col("hi"))})
    step = F.when((F.col("f") > 0) & (F.col("target") > 0), F.try_divide(F.log(F.col("target") / F.col("f")) * F.col("f"), F.col("d")))
    wanted = F.col("lam") + step
    inside = step.isNotNull() & ~F.isnan(step) & (wanted > F.col("lo")) & (wanted < F.col("hi"))
    # A source without words has none to take at any rate.
    now = now.withColumn("done", F.col("done") | (F.col("f") <= 0) | (F.abs(F.col("f") - F.col("target")) < CLOSE * F.greatest("target", F.lit(1.0))))
    return now.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, wanted).otherwise((F.col("lo") + F.col("hi")) / 2)).select(*state.columns)


def rates(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` with lam and mean, from ``cells`` (source, size, n): Newton's method on the logarithm of the tokens.

    A source at its limit of ``cap`` times its size gets an endless lam: its rates are all ``cap``.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = _join_source(mean, sources).select(
        "source", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"), F.when(full, F.lit(1e30)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-1e12).alias("lo"), F.lit(1e12).alias("hi"), full.alias("done")
    )
    state = written(state, "dual")
    few = state.count() <= BROADCAST_SOURCES
    for _ in range(0, ROUNDS, STEPS):
        if state.where("NOT done").isEmpty():
            break
        for _ in range(STEPS):
            state = _newton(state, cells, cap, few)
        state = written(state, "dual")
    return state.select("source", "source_size", "target", "lam", "mean")


def _rate(size: Column, cap: int) -> Column:
    return F.when(F.col("lam") >= 1e29, F.lit(float(cap))).otherwise(_tilt(size, F.col("lam"), F.col("mean"), cap))


def _copies(size: Column, u: Column, shift: Column, cap: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(_rate(size, cap) + u + shift))).cast("int")


def _shifts(places: DataFrame, tilted: DataFrame, cap: int, few: bool) -> DataFrame:
    """``tilted`` with shift and taken (words): the shift of a source at which its copies' words come nearest to its target.

    A histogram has a row for each source and bin of the shifts at which copies begin; its running sums say which bin the target is in,
    and the next histogram is over that bin alone.
    """
    begins = F.explode(F.array(*[F.lit(float(k)) - _rate(F.col("size"), cap) - F.col("u") for k in range(1, cap + 1)])).alias("at")
    state = tilted.withColumns({"lo": F.lit(-1.0 * cap), "hi": F.lit(1.0 * cap), "below": F.lit(0).cast("bigint"), "shift": F.lit(0.0), "taken": F.lit(0.0)})
    names = state.columns
    state = written(state, "shifts")
    for _ in range(SHIFTS):
        width = (F.col("hi") - F.col("lo")) / BINS
        rows = _join_source(places, F.broadcast(state) if few else state)
        inside = rows.select("source", begins, "lo", "hi", (F.col("n") * F.col("size")).alias("words")).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        bins = inside.groupBy("source", F.least(F.lit(BINS - 1), F.floor((F.col("at") - F.col("lo")) / width)).alias("bin")).agg(F.sum("words").alias("words"))
        order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        sums = bins.withColumn("upto", F.sum("words").over(order))
        now = _join_source(sums, F.broadcast(state) if few else state)
        now = now.withColumns({"upto": F.col("below") + F.col("upto"), "edge": F.col("lo") + (F.col("bin") + 1) * width})
        crossing = F.min(F.when(F.col("upto") >= F.col("target"), F.struct("bin", "upto", "words", "edge", width.alias("width"))))
        last = F.max(F.struct("bin", "upto", "words", "edge", width.alias("width")))
        found = now.groupBy("source").agg(F.coalesce(crossing, last).alias("c"))
        # At the upper edge of the bin all of its copies have begun, at the lower one none has.
        gap = lambda taken: F.abs(taken - F.col("target"))
        start, end = F.col("c.edge") - F.col("c.width"), F.col("c.edge")
        before = F.col("c.upto") - F.col("c.words")
        nearer = gap(before) < gap(F.col("c.upto"))
        # A source without words, or with none in its last bin, stays as it is.
        now = _join_source(state, found, "left").withColumns({
            "shift": F.when(F.col("c").isNull(), F.col("shift")).when(nearer, start).otherwise(end), "taken": F.when(F.col("c").isNull(), F.col("taken")).when(nearer, before).otherwise(F.col("c.upto")).cast("double"),
            "below": F.when(F.col("c").isNull(), F.col("below")).otherwise(before).cast("bigint"), "lo": F.when(F.col("c").isNull(), F.col("lo")).otherwise(start), "hi": F.when(F.col("c").isNull(), F.col("hi")).otherwise(end),
        })
        state = written(now.select(*names), "shifts")
        if state.where(F.abs(F.col("taken") - F.col("target")) > NEAR * F.col("target")).isEmpty():
            break
    return state.drop("lo", "hi", "below")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> MixPlan:
    """What :func:`apply` needs, from a written table of :func:`sized` rows."""
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilted = rates(cells, written(targets(sizes, weights, share, cap), "targets"), cap)

    # Rows of one source, size and id move together: repeated rows have the same number of copies.
    places = written(rows.where("size > 0").groupBy("source", "size", "u").agg(F.count(F.lit(1)).alias("n")), "places")
    tilted = written(tilted, "tilted")
    few = tilted.count() <= BROADCAST_SOURCES
    state = _shifts(places, tilted, cap, few)

    changes = written(state.limit(0).select("source", F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("u"), F.lit(0).alias("by")), "changes")
    for _ in range(CHANGES):
        off = small(state.where(F.abs(F.col("taken") - F.col("target")) > NEAR * F.col("target")), BROADCAST_SOURCES)
        if off.isEmpty():
            break
        gap = F.col("target") - F.col("taken")
        mine = changes.withColumnRenamed("source", "s").withColumnRenamed("size", "z").withColumnRenamed("u", "v")
        free = _join_source(places, off).join(small(mine, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("u") == F.col("v")), "left").where("by IS NULL")
        copies = _copies(F.col("size"), F.col("u"), F.col("shift"), cap)
        fits = F.when(gap > 0, copies < cap).otherwise(copies > 0) & (F.col("size") * F.col("n") <= 1.99 * F.abs(gap))
        closeness = -F.abs(F.abs(gap) - F.col("size") * F.col("n"))
        pick = free.where(fits).groupBy("source").agg(F.max(F.struct(closeness.alias("c"), "size", "u", "n", F.signum(gap).cast("int").alias("by"))).alias("p"))
        pick = written(pick.select("source", "p.size", "p.u", "p.by", (F.col("p.by") * F.col("p.size") * F.col("p.n")).alias("added")), "picks")
        if pick.isEmpty():
            break
        changes = written(changes.unionByName(pick.select(*changes.columns)), "changes")
        state = written(_join_source(state, pick.select("source", "added"), "left").withColumn("taken", F.col("taken") + F.coalesce("added", F.lit(0))).select(*state.columns), "shifts")
    return MixPlan(state.select("source", "source_size", "target", "lam", "mean", "shift"), changes)


def apply(rows: DataFrame, p: MixPlan, cap: int = CAP) -> DataFrame:
    """``rows`` (with source, size and u) with source_size, target, rate, copies and taken; the plan's small tables are joined to them."""
    mine = p.changes.withColumnRenamed("source", "s").withColumnRenamed("size", "z").withColumnRenamed("u", "v")
    out = _join_source(rows, small(p.sources, BROADCAST_SOURCES))
    out = out.join(small(mine, 4 * BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("u") == F.col("v")), "left")
    rate = _rate(F.col("size"), cap)
    copies = _copies(F.col("size"), F.col("u"), F.col("shift"), cap) + F.coalesce("by", F.lit(0))
    out = out.withColumns({"rate": rate, "copies": copies}).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("lam", "mean", "shift", "s", "z", "v", "by")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``id_col``, size (whitespace-separated words; null: 0), source_size, target (the
    source's), rate, copies and taken (copies * size); one row for each input row. Sources are
    weighted in code point order, null last. Texts without words have nothing to take.
    Repeated rows get equal copies, as the hash of their id says; a null id has a hash of its own.
    A corpus without words has targets of 0; an empty table gives no rows. Reruns agree.
    """
    rows = written(sized(docs, id_col, text_col, source_col), "sized")
    out = apply(rows, plan(rows, weights, share, cap), cap)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", "taken")
