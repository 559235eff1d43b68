"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.scratch import save

#: Edges that one task may unite (16 bytes each, and as much again for its table); more take rounds.
ONE_TASK = 500_000


def _united(edges: DataFrame) -> DataFrame:
    """node, root by union-find in one task, for at most ONE_TASK edges."""

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(unite, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for a table of edges a, b (long).

    Every round is two joins of the edges with each node's least neighbour; no
    node's neighbours are gathered.  The number of rounds grows as the logarithm
    of the longest path.  A table of at most ``ONE_TASK`` edges is united in one
    task instead.  Nodes are those of the edges; an edge from a node to itself
    makes the node a component, if it has no other edge.
    """
    if edges.count() <= ONE_TASK:
        return _united(edges)
    alone = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    nodes = save(alone, "nodes")
    links = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = save(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = save(small, "small-star")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
