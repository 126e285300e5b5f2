"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import staged


def _stars(edges: DataFrame) -> DataFrame:
    """One round on (u, v) pairs; the result has an edge from each node to a smaller one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    # Now all edges lead down; each node's lower neighbours and the node itself go to the least of them.
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for each node with an edge; the root is the least node of its component.

    ``edges`` has u and v of any ordered type. Every round is written to the shared folder. The rounds
    grow with the logarithm of the number of nodes; ``limit`` only guards against a bug.
    """
    now, mark = staged(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    for _ in range(limit):
        now = staged(_stars(now), "edges")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge leads from a node to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
