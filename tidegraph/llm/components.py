"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stage, unstage

#: Edges for each task of a round: a round of few edges takes few tasks, whatever the session's shuffle partitions.
EDGES_PER_TASK = 400_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node links its neighbours (large: those above it; small: those not above it, and itself) to the least of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # the node itself goes along as one more neighbour
        out = linked.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    Each round is written to the shared folder, and the one before deleted; it ends when a round changes nothing.  The
    rounds needed grow with the logarithm of the nodes, squared at most; past ``most_rounds`` RuntimeError is raised
    rather than a wrong result given.  An empty table has no nodes; null edges, loops and repeated edges don't matter.
    """
    now = stage(edges.select("a", "b").filter(F.col("a") != F.col("b")), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    for _ in range(most_rounds if seen[0] else 0):
        tasks = max(1, seen[0] // EDGES_PER_TASK)
        last, now = now, stage(_star(_star(now.coalesce(tasks), True, tasks), False, tasks), "edges")
        unstage(last)
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    tasks = max(1, seen[0] // EDGES_PER_TASK)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).coalesce(tasks)
