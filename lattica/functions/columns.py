"""Formula values as Spark columns: an error is a value, never an exception.

A ``Val`` carries a column for each kind it may have and, if it can fail, a
column with the error token (null: no error).  What is known statically prunes
the rest, so a formula over typed columns becomes plain arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.values import NUMBER

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_KIND = {"number": "double", "text": "string", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}


@dataclass(frozen=True)
class Val:
    cols: dict[str, Column]  # by kind; "blank" maps to None
    kind: Column
    err: Column | None = None

    @property
    def kinds(self) -> frozenset:
        return frozenset(self.cols)

    def is_kind(self, kind: str) -> Column:
        """Whether the value, if no error, is of the kind."""
        if kind not in self.cols:
            return F.lit(False)
        return F.lit(True) if len(self.cols) == 1 else self.kind == kind

    def native(self) -> Column:
        """The payload of a value with one kind besides blank; null for blank and error."""
        (kind,) = [k for k in self.cols if k != "blank"] or ["blank"]
        if kind == "blank":
            return F.lit(None).cast("string")
        ok = self.is_kind(kind)
        if self.err is not None:
            ok = ok & self.err.isNull()
        return F.when(ok, self.cols[kind])

    def error(self) -> Column:
        return F.lit(None).cast("string") if self.err is None else self.err


def of(kind: str, col: Column | None, err: Column | None = None) -> Val:
    return Val({kind: col}, F.lit(kind), err)


def fail(token: str | Column) -> Val:
    return Val({}, F.lit("error"), F.lit(token) if isinstance(token, str) else token)


def literal(v) -> Val:
    if isinstance(v, bool):
        return of("boolean", F.lit(v))
    if isinstance(v, float):
        return of("number", F.lit(v))
    return of("text", F.lit(v))


def first_error(*errs: Column | None) -> Column | None:
    there = [e for e in errs if e is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def from_column(name: str, kind: T.DataType, nullable: bool = True) -> Val:
    """A bound table's column; null is blank."""
    c, err = F.col(f"`{name}`"), None
    if isinstance(kind, T.BooleanType):
        own = "boolean"
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        own, c = "number", c.cast("double")
        err = F.when(~(F.abs(c) < math.inf), F.lit("#NUM!"))
    elif isinstance(kind, (T.LongType, T.DecimalType)):
        own = "number"
        err = F.when(F.abs(c) > 2**53, F.lit("#NUM!"))
        c = c.cast("double")
    elif isinstance(kind, T.NumericType):
        own, c = "number", c.cast("double")
    elif isinstance(kind, T.StringType):
        own = "text"
    elif isinstance(kind, T.DateType):
        own = "date"
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        own = "datetime"
    else:
        raise TypeError(f"{name}: {kind.simpleString()} has no kind")
    if not nullable:
        return of(own, c, err)
    return Val({own: c, "blank": None}, F.when(F.col(f"`{name}`").isNull(), "blank").otherwise(own), err)


def choose(cond: Column, a: Val, b: Val, err: Column | None) -> Val:
    """a where cond holds, else b, unless err."""
    kinds = a.kinds | b.kinds
    cols = {}
    for k in kinds:
        if k == "blank":
            cols[k] = None
        elif k in a.cols and k in b.cols:
            cols[k] = F.when(cond, a.cols[k]).otherwise(b.cols[k])
        else:
            cols[k] = F.when(cond, a.cols[k]) if k in a.cols else F.when(~cond, b.cols[k])
    branch = None
    if a.err is not None or b.err is not None:
        branch = F.when(cond, a.error()).otherwise(b.error())
    return Val(cols, F.when(cond, a.kind).otherwise(b.kind), first_error(err, branch))


def _coerce(v: Val, rules: dict[str, Callable[[Column | None], Column]]) -> tuple[Column, Column | None]:
    """(column, error): each kind by its rule, kinds without a rule are #VALUE!."""
    known = [k for k in v.cols if k in rules]
    wrong = [k for k in v.cols if k not in rules]
    if not known:
        kind = SQL_KIND.get(next(iter(rules)), "double")
        return F.lit(None).cast(kind), first_error(v.err, F.lit("#VALUE!")) if v.cols else v.err
    out = rules[known[-1]](v.cols[known[-1]])
    for k in known[:-1]:
        out = F.when(v.kind == k, rules[k](v.cols[k])).otherwise(out)
    err = v.err
    if wrong:
        err = first_error(err, F.when(v.kind.isin(wrong), F.lit("#VALUE!")))
    return out, err


def number(v: Val) -> tuple[Column, Column | None]:
    return _coerce(v, {"number": lambda c: c, "blank": lambda c: F.lit(0.0), "boolean": lambda c: c.cast("double")})


def logical(v: Val) -> tuple[Column, Column | None]:
    return _coerce(v, {"boolean": lambda c: c, "blank": lambda c: F.lit(False), "number": lambda c: c != 0})


def text(v: Val) -> tuple[Column, Column | None]:
    return _coerce(
        v,
        {
            "text": lambda c: c,
            "blank": lambda c: F.lit(""),
            "number": spell_number,
            "boolean": lambda c: F.when(c, "TRUE").otherwise("FALSE"),
            "date": lambda c: F.date_format(c, "yyyy-MM-dd"),
            "datetime": lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(c, ".SSSSSS"), "0+$", ""), r"^\.$", ""), F.lit("Z")),
        },
    )


def finite(x: Column, *errs: Column | None) -> Val:
    """A number that is #NUM! unless finite."""
    return of("number", x, first_error(*errs, F.when(~(F.abs(x) < math.inf), F.lit("#NUM!"))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once; keeps large expressions from growing as a power of their depth."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spell_number(x: Column) -> Column:
    """The shortest spelling that reads back as x; scientific only if strictly shorter.

    Digits are the JVM's, which writes two where one would do for the smallest
    subnormal numbers (4.9e-324 for 5e-324).
    """

    def parts(shown: Column) -> Column:  # -d.dddE±n or -ddd.ddd, the shortest digits
        unsigned = F.ltrim(shown, F.lit("-"))
        mantissa = F.substring_index(unsigned, "E", 1)
        power = F.when(F.instr(unsigned, "E") > 0, F.substring_index(unsigned, "E", -1).cast("int")).otherwise(0)
        return F.struct(
            F.startswith(shown, F.lit("-")).alias("minus"),
            F.substring_index(mantissa, ".", 1).alias("left"),
            F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0")).alias("right"),
            power.alias("power"),
        )

    def digits(d: Column) -> Column:
        whole = F.ltrim(F.concat(d["left"], d["right"]), F.lit("0"))
        return F.struct(d["minus"].alias("minus"), whole.alias("whole"), F.rtrim(whole, F.lit("0")).alias("short"), (d["power"] - F.length(d["right"])).alias("power"))

    def scaled(d: Column) -> Column:
        return F.struct(d["minus"].alias("minus"), d["short"].alias("s"), F.length(d["short"]).alias("n"), (d["power"] + F.length(d["whole"]) - F.length(d["short"])).alias("p"))

    def spellings(d: Column) -> Column:
        s, n, p = d["s"], d["n"], d["p"]
        plain = (
            F.when(n == 0, "0")
            .when(p >= 0, F.concat(s, F.repeat(F.lit("0"), p)))
            .when(p > -n, F.concat(F.substring(s, F.lit(1), n + p), F.lit("."), F.substring(s, n + p + 1, -p)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - n), s))
        )
        science = F.concat(F.substring(s, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(s, F.lit(2), n))).otherwise(""), F.lit("e"), (p + n - 1).cast("string"))
        return F.struct(F.when(d["minus"], "-").otherwise("").alias("sign"), plain.alias("plain"), F.when(n > 0, science).otherwise("0").alias("science"))

    def best(d: Column) -> Column:
        return F.concat(d["sign"], F.when(F.length(d["science"]) < F.length(d["plain"]), d["science"]).otherwise(d["plain"]))

    out = let(x.cast("string"), parts)
    for step in (digits, scaled, spellings, best):
        out = let(out, step)
    return out


def unary(op: str, v: Val) -> Val:
    x, err = number(v)
    return of("number", F.negate(x) if op == "-" else x, err)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    (x, ex), (y, ey) = number(a), number(b)
    ex = first_error(a.err, b.err, ex)  # both operands are evaluated before either is coerced
    if op == "/":
        return finite(F.try_divide(x, y), ex, ey, F.when(y == 0, F.lit("#DIV/0!")))
    if op == "^":
        own = F.when((x == 0) & (y < 0), F.lit("#DIV/0!")).when((x < 0) & (y != F.rint(y)), F.lit("#NUM!"))
        return finite(F.pow(x, y), ex, ey, own)
    return finite({"+": x + y, "-": x - y, "*": x * y}[op], ex, ey)


def concat(a: Val, b: Val) -> Val:
    (x, ex), (y, ey) = text(a), text(b)
    return of("text", F.concat(x, y), first_error(a.err, b.err, ex, ey))


def compare(op: str, a: Val, b: Val) -> Val:
    err = first_error(a.err, b.err)
    if not a.cols or not b.cols:
        return of("boolean", F.lit(False), err)
    both = a.kinds & b.kinds
    if op in ("=", "<>"):
        same = F.lit(False)
        for k in both:
            same = same | (a.is_kind(k) & b.is_kind(k) & (F.lit(True) if k == "blank" else F.coalesce(a.cols[k] == b.cols[k], F.lit(False))))
        return of("boolean", same if op == "=" else ~same, err)
    ordered = [k for k in both if k != "blank"]
    if not ordered:
        return of("boolean", F.lit(False), first_error(err, F.lit("#VALUE!")))
    out, fits = F.lit(False), F.lit(False)
    for k in ordered:
        x, y = a.cols[k], b.cols[k]
        here = a.is_kind(k) & b.is_kind(k)
        out = F.when(here, {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]).otherwise(out)
        fits = fits | here
    if len(a.cols) > 1 or len(b.cols) > 1:
        err = first_error(err, F.when(~fits, F.lit("#VALUE!")))
    return of("boolean", out, err)


def _two_product(x: Column, f: float) -> tuple[Column, Column]:
    """x * f as an exact sum of two doubles (Dekker)."""

    def split(v):
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    p = x * F.lit(f)
    xh, xl = split(x)
    fh, fl = split(f)
    return p, ((xh * fh - p) + xh * fl + xl * fh) + xl * fl


def exact_round(x: Column, digits: int, how: str) -> Column:
    """Rounding of the exact binary value to -15..15 digits, half away from zero for ROUND."""
    if not -15 <= digits <= 15:
        raise ValueError("digits beyond 15 are left to the interpreter")
    scale = 10.0 ** abs(digits)

    def scaled(v: Column) -> Column:
        a = F.abs(v)
        if digits >= 0:
            whole, rest = _two_product(a, scale)
            k = F.floor(whole).cast("double")
            over = (whole - k) + rest  # exact while whole < 2**52
        else:
            k = F.floor(a / scale).cast("double")
            over = (a - k * scale) / scale
            whole = F.lit(0.0)
        return F.struct(v.alias("x"), k.alias("k"), over.alias("over"), (whole >= 2.0**52).alias("all"))

    def rounded(d: Column) -> Column:
        k, over = F.when(d["over"] < 0, d["k"] - 1).otherwise(d["k"]), F.when(d["over"] < 0, d["over"] + 1).otherwise(d["over"])
        up = {"ROUND": over >= 0.5, "ROUNDUP": over > 0, "ROUNDDOWN": F.lit(False)}[how]
        n = F.when(up, k + 1).otherwise(k)
        out = F.when(d["all"], F.abs(d["x"])).otherwise(n / scale if digits >= 0 else n * scale)
        return F.when(F.startswith(d["x"].cast("string"), F.lit("-")), F.negate(out)).otherwise(out)

    return let(let(x, scaled), rounded)


def infer(field: Column) -> Val:
    """A source field's value, by the fixed order of interpretation (formulas and datetimes stay text)."""
    forced = F.startswith(field, F.lit("'"))
    n = F.when(field.rlike(f"^(?:{NUMBER.pattern})$"), field.try_cast("double"))
    day = F.when(field.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), field.try_cast("date"))
    token = F.when(field.isin("#DIV/0!", "#N/A", "#NAME?", "#NUM!", "#REF!", "#VALUE!", "#CIRC!"), field)
    kind = (
        F.when(field == "", "blank")
        .when(forced, "text")
        .when(field.isin("true", "false"), "boolean")
        .when(F.abs(n) < math.inf, "number")
        .when(day.isNotNull(), "date")
        .otherwise("text")
    )
    plain = F.when(forced, F.substring(field, F.lit(2), F.length(field))).otherwise(field)
    return Val({"text": plain, "boolean": field == "true", "number": n, "date": day, "blank": None}, kind, token)

