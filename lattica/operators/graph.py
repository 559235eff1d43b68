"""Dependency graphs as edge tables (dst reads src): closures, levels, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.ranking import settled


def _frame(edges: DataFrame) -> DataFrame:
    return edges.select("dst", "src").distinct()


def closure(edges: DataFrame, roots: DataFrame, against: bool = True) -> DataFrame:
    """node: the roots and all that depends on them (``against``: False for all that they depend on)."""
    take, give = ("src", "dst") if against else ("dst", "src")
    links = settled(_frame(edges))
    seen = settled(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    front = seen
    while True:
        reached = front.join(links, front["node"] == links[take]).select(F.col(give).alias("node")).distinct()
        front = settled(reached.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = settled(seen.unionByName(front))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: 0 without dependencies, else one more than the highest of them; null for nodes in or behind a cycle.

    Each round settles one level, as many rounds as the longest chain.
    """
    links = settled(_frame(edges))
    open_ = settled(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    done, level = None, 0
    while True:
        blocked = links.join(open_.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        ready = settled(open_.join(blocked, "node", "left_anti"))
        if ready.isEmpty():
            break
        found = ready.withColumn("level", F.lit(level).cast("long"))
        done = found if done is None else done.unionByName(found)
        open_ = settled(open_.join(ready, "node", "left_anti"))
        level += 1
    rest = open_.withColumn("level", F.lit(None).cast("long"))
    return rest if done is None else done.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, scc (its strongly connected component's least node), cyclic, of the nodes that lie on cycles.

    What has no dependency or no dependent left is trimmed first; of what stays,
    each node's component is named by the least node that it both reaches and is
    reached from.
    """
    links = settled(_frame(edges))
    while True:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = settled(kept.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("dst", "src"))
        if kept.count() == links.count():
            break
        links = kept
    reach = settled(links)
    while True:
        longer = reach.unionByName(reach.alias("a").join(reach.alias("b"), F.col("a.src") == F.col("b.dst")).select("a.dst", "b.src")).distinct()
        longer = settled(longer)
        if longer.count() == reach.count():
            break
        reach = longer
    both = reach.alias("a").join(reach.alias("b"), (F.col("a.dst") == F.col("b.src")) & (F.col("a.src") == F.col("b.dst")))
    return both.groupBy(F.col("a.dst").alias("node")).agg(F.min("a.src").alias("scc"))
