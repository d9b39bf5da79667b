"""Connected components of a graph given as edges, by joins and partial aggregates only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.base import written

#: Rounds after which something must be wrong: the number of rounds grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Nodes that have an edge, with the least node of their component: (node, component).

    `edges` has columns u and v of one type.  Alternating large and small stars, each written to the shared folder,
    until both leave the edges as they are; then every node is linked to the least one of its component.  A node's
    neighbours are never gathered: minima are partial aggregates, and joins on a node of many edges can be split.
    """
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(MAX_ROUNDS):
        nxt = written(_small_star(_large_star(current)), name)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = (state[0], state[1])
        if state == before:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, current = state, nxt
    raise RuntimeError("components did not settle")
