"""Row positions, neighbours and running sums over a whole table in a total order, without one task for all rows.

The table is range-partitioned by the order and written to the checkpoint
folder once, so that its parts stay what they are; each part is numbered on its
own, and what a part needs of those before it is one row a part.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PART, _POS = "__part", "__pos"


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the session's checkpoint folder (a local session may lack one)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-"))
    return df.checkpoint()


def parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions of the order, numbered by ``__part``."""
    dealt = df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id())
    return settled(dealt)


def _offsets(placed: DataFrame, amount: Column) -> DataFrame:
    """__part and the sum of ``amount`` over all parts before it; a row a part."""
    sums = placed.groupBy(_PART).agg(amount.alias("__sum"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(_PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))


def positions(df: DataFrame, order: list[str], name: str = _POS) -> DataFrame:
    """df with each row's place in the order, from 1."""
    placed = parts(df, order)
    own = F.row_number().over(Window.partitionBy(_PART).orderBy(*order))
    out = placed.join(F.broadcast(_offsets(placed, F.count("*"))), _PART)
    return out.withColumn(name, (own + F.col("__before")).cast("long")).drop(_PART, "__before")


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to and including each."""
    placed = parts(df.withColumn("__value", value), order)
    own = F.sum("__value").over(Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(F.broadcast(_offsets(placed, F.sum("__value"))), _PART)
    return out.withColumn(name, own + F.col("__before")).drop(_PART, "__before", "__value")


def shifted(df: DataFrame, order: list[str], wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """df with, for each new column, an old column's value ``d`` rows further on (d < 0: before); null beyond the ends.

    One equi-join by position for each distance.
    """
    placed = positions(df, order)
    for d in sorted({d for _, d in wanted.values() if d}):
        mine = {new: old for new, (old, k) in wanted.items() if k == d}
        other = placed.select((F.col(_POS) - d).alias(_POS), *(F.col(old).alias(new) for new, old in mine.items()))
        placed = placed.join(other, _POS, "left")
    for new, (old, d) in wanted.items():
        if not d:
            placed = placed.withColumn(new, F.col(old))
    return placed
