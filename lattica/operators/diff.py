"""Differences between two versions of a table or workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(before: DataFrame, after: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, change (added, removed, changed), before, after of what differs in one column; a missing row is not a null one."""
    a = before.select(*key, F.col(column).alias("before"), F.lit(True).alias("in_a"))
    b = after.select(*key, F.col(column).alias("after"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(*key, "change", "before", "after")


def cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of sparse cells (row, col, txt)."""
    return rows(before, after, ["row", "col"], "txt")


def membership(before: DataFrame, after: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """key, change of members added, removed, moved (another place) or relabelled; several changes are several rows."""
    a = before.select(key, F.col(order).alias("o1"), F.col(label).alias("l1"))
    b = after.select(key, F.col(order).alias("o2"), F.col(label).alias("l2"))
    both = a.join(b, key, "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("o1").isNull(), F.lit("added")),
            F.when(F.col("o2").isNull(), F.lit("removed")),
            F.when(F.col("o1") != F.col("o2"), F.lit("moved")),
            F.when(F.col("l1") != F.col("l2"), F.lit("relabelled")),
        )
    )
    return both.select(key, F.explode(found).alias("change"))


def override(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with a column's values replaced where changes (key, value) has the row."""
    new = changes.select(key, F.col("value").alias("__new"), F.lit(True).alias("__set"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__set")


def move(cells_: DataFrame, d_row: int, d_col: int, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """Cells with the block inside the rectangle moved by (d_row, d_col)."""
    inside = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
    return cells_.select((F.col("row") + F.when(inside, d_row).otherwise(0)).alias("row"), (F.col("col") + F.when(inside, d_col).otherwise(0)).alias("col"), "txt")
