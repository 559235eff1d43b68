"""A stream of literal overrides folded into a table, and the formulas over it recomputed for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import diff
from lattica.plans.book import Book


def latest(changes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One override a key: the last by order."""
    return changes.groupBy(key).agg(F.max_by(value, order).alias("value"))


def follow(changes: DataFrame, base: DataFrame, key: str, column: str, order: str, formulas: dict[str, str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch of the stream (key, value, order) give ``sink`` the formulas' row over the base table with all overrides so far.

    The table is named ``t`` in the formulas.  Overrides so far are kept by
    Spark's own streaming state (complete mode), so a restart goes on from the
    checkpoint.
    """

    def step(overrides: DataFrame, batch: int) -> None:
        book = Book(base.sparkSession)
        book.bind("t", diff.override(base, overrides, key, column))
        sink(book.scalars(**formulas), batch)

    state = latest(changes, key, "value", order)
    return state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(step).start()
