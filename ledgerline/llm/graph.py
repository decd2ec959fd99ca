"""Connected components of a graph whose edges are rows.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): the edges of a step are never more
than those of the step before, and nothing is gathered for one node.  The edges
of a node meet its least neighbour in parts, so that the hub of a large star is
no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_salt, salt, salts, stored


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(u, v)`` with m, the least v of each u; and (u, m) alone."""
    edges = edges.withColumn("part", salt("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), salts("part").alias("bits"))
    return edges.join(least.select("u", "m", each_salt("bits").alias("part")), ["u", "part"]).drop("part"), least.select("u", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the least node of the component.

    Self-loops and null ends carry no link and are left out, as are nodes
    without an edge.  Repeated edges count once.  No edges: no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, _ = _with_least(both)
        large = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met, least = _with_least(large)
        inner = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
