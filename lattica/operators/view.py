"""Rectangles over cells: viewports, styles by precedence, geometry, clipped regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a sheet that share a bucket of the rectangle join.
BUCKET = 1024


def cells(df: DataFrame, row: Column, headers: list[str]) -> DataFrame:
    """A table as sparse cells (row, col, txt); nulls are no cells."""
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).cast("long").alias("col"), F.col(h).cast("string").alias("txt")) for k, h in enumerate(headers))))
    return df.select(row.cast("long").alias("row"), each.alias("c")).select("row", "c.col", "c.txt").where("txt is not null")


def viewport(sparse: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    return sparse.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def cover(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points (row, col, …) joined with all rectangles (r0, c0, r1, c1, …) that contain them: an equi-join on row buckets."""
    spread = rects.withColumn("b", F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET))))
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return points.withColumn("b", F.floor(F.col("row") / BUCKET)).join(spread, "b").where(inside).drop("b")


def styles(points: DataFrame, applies: DataFrame, properties: list[str]) -> DataFrame:
    """row, col and each property's value from the last apply (by source_order) that sets it; points without any apply are left out."""
    found = cover(points.select("row", "col"), applies)
    last = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col("source_order"))).alias(p) for p in properties]
    return found.groupBy("row", "col").agg(*last)


def geometry(intervals: DataFrame) -> DataFrame:
    """first, last, size: disjoint intervals, a later declaration (source_order) overwriting an earlier one."""
    edges = intervals.select(F.col("first").alias("at")).unionByName(intervals.select((F.col("last") + 1).alias("at"))).distinct()
    pieces = edges.select("at", (F.lead("at").over(Window.orderBy("at")) - 1).alias("upto")).where("upto is not null")  # declarations of a sheet
    held = pieces.join(F.broadcast(intervals), (F.col("first") <= F.col("at")) & (F.col("last") >= F.col("upto")))
    sized = held.groupBy("at", "upto").agg(F.max_by("size", "source_order").alias("size"))
    same = Window.orderBy("at")
    start = (F.lag("size").over(same) != F.col("size")) | (F.lag("upto").over(same) + 1 != F.col("at")) | F.lag("at").over(same).isNull()
    runs = sized.withColumn("run", F.sum(start.cast("int")).over(same))
    return runs.groupBy("run").agg(F.min("at").alias("first"), F.max("upto").alias("last"), F.first("size").alias("size")).drop("run")


def clip(rects: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """Rectangles cut to a viewport; those outside go."""
    cut = rects.withColumns({"r0": F.greatest("r0", F.lit(r0)), "c0": F.greatest("c0", F.lit(c0)), "r1": F.least("r1", F.lit(r1)), "c1": F.least("c1", F.lit(c1))})
    return cut.where("r0 <= r1 and c0 <= c1")


def overlaps(rects: DataFrame) -> DataFrame:
    """Pairs a < b of footprints (id, sheet, r0, c0, r1, c1) on a sheet that share a cell, by an equi-join on row buckets."""
    spread = rects.withColumn("b", F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET))))
    x, y = spread.alias("x"), spread.alias("y")
    meet = (F.col("x.r0") <= F.col("y.r1")) & (F.col("y.r0") <= F.col("x.r1")) & (F.col("x.c0") <= F.col("y.c1")) & (F.col("y.c0") <= F.col("x.c1"))
    return x.join(y, (F.col("x.sheet") == F.col("y.sheet")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.id") < F.col("y.id")) & meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
