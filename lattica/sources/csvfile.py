"""CSV files as named tables of inferred values, and tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.plans.report import csv_field


def read(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header, each field interpreted by the source rules.

    A column named in ``kinds`` (number, boolean, date or text) has that type,
    and fields of another kind are null in it; their number is in no way
    hidden: ``misread`` gives it.  Other columns stay text, an empty field being
    null.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, nullValue="\0", emptyValue="", mode="FAILFAST")
    out = []
    for name in raw.columns:
        field = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        v, kind = C.infer(field), (kinds or {}).get(name, "text")
        if kind == "text":
            out.append(F.when(field != "", F.when(F.startswith(field, F.lit("'")), v.cols["text"]).otherwise(field)).alias(name))
        else:
            out.append(F.when(v.err.isNull() & (v.kind == kind), v.cols[kind]).alias(name))
    return raw.select(*out)


def misread(spark: SparkSession, path: str, kinds: dict[str, str]) -> dict[str, int]:
    """For each column of ``kinds`` how many fields are neither blank nor of the kind."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, nullValue="\0", emptyValue="", mode="FAILFAST")
    sums = []
    for name, kind in kinds.items():
        v = C.infer(F.coalesce(F.col(f"`{name}`"), F.lit("")))
        sums.append(F.sum(F.when(v.err.isNotNull() | ~v.kind.isin(kind, "blank"), 1).otherwise(0)).alias(name))
    return {k: n or 0 for k, n in raw.agg(*sums).first().asDict().items()}


def lines(df: DataFrame) -> DataFrame:
    """df as CSV lines (column ``line``): canonical spelling, quotes only where needed."""
    out = []
    for f in df.schema:
        v = C.from_column(f.name, f.dataType, f.nullable)
        spelled, _ = C.text(v)
        if "boolean" in v.cols:
            spelled = F.translate(spelled, C.UPPER, C.LOWER)
        if "text" in v.cols:  # text that would read as something else is forced
            c = v.cols["text"]
            other = C.infer(c)
            plain = (other.kind == "text") & other.err.isNull() & ~F.startswith(c, F.lit("'")) & ~F.startswith(c, F.lit("="))
            spelled = F.when(c.isNull(), "").when(plain, c).otherwise(F.concat(F.lit("'"), c))
        out.append(csv_field(spelled))
    return df.select(F.concat_ws(",", *out).alias("line"))
