"""Connected components as a distributed iteration (large star, small star) over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.shared import written

MAX_ROUNDS = 60


#: Edges up to which the smallest neighbours are broadcast; beyond, they are joined by shuffle.
BROADCAST_EDGES = 200_000


def _near_minimum(arcs: DataFrame, few: bool) -> DataFrame:
    """Arcs (u, v) with the smallest of u and its v, by a partial aggregation and a join that Spark can split."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(F.broadcast(least) if few else least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node that can be reached.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    seen, n = None, now.count()
    for _ in range(MAX_ROUNDS):
        few = n <= BROADCAST_EDGES
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _near_minimum(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        near = _near_minimum(large, few)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == seen:
            break
        seen = (n, mark)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
