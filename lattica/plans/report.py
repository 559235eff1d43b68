"""Checks and reports: assertions, conversion fidelity, calculated CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions.values import spell_number
from lattica.plans.book import Book

#: Outcomes from best to worst, and the fidelity that the worst of a conversion stands for.
OUTCOMES = ("preserved", "converted", "approximated", "omitted", "refused")
_FIDELITY = {"preserved": "lossless", "converted": "lossless", "approximated": "lossy", "omitted": "unsupported", "refused": "unsupported"}


def assertions(book: Book, table: str, key: str, rules: list[tuple[str, str, float | str | bool]]) -> DataFrame:
    """key, code, failed: a row for each data row and rule (header, operator, literal) that does not hold; an error value never holds."""
    bound, out = book.tables[table], []
    for header, op, value in rules:
        holds = C.compare(op, bound.vals[header], C.literal(value))
        spelled = spell_number(value) if isinstance(value, float) else str(value)
        fine = F.coalesce(holds.native(), F.lit(False))
        out.append(F.when(~fine, F.struct(F.lit("MS3201").alias("code"), F.lit(f"{header} {op} {spelled}").alias("failed"))))
    return bound.df.select(key, F.explode(F.array_compact(F.array(*out))).alias("r")).select(key, "r.code", "r.failed")


def fidelity(outcomes: DataFrame) -> DataFrame:
    """feature, fidelity, n for rows (feature, outcome): the worst outcome decides."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    worst = outcomes.groupBy("feature").agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    name = F.element_at(F.array(*(F.lit(_FIDELITY[o]) for o in OUTCOMES)), F.col("r").cast("int"))
    return worst.select("feature", name.alias("fidelity"), "n")


def neutral(field: Column) -> Column:
    """A calculated field that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(field.rlike(r"^[\s\p{Cntrl}]*[=+\-@]"), F.concat(F.lit("'"), field)).otherwise(field)


def csv_field(field: Column) -> Column:
    """Quoted only where CSV needs it."""
    return F.when(field.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)
