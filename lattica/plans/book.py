"""Named tables over DataFrames, and formulas over them compiled to Spark plans.

``bind`` makes a DataFrame a named table.  ``fill`` adds a derived column from a
formula with current-row references; ``table`` gives the filled table back;
``scalars`` evaluates whole-table formulas, all aggregates of a table in one
scan.  Row order matters to MATCH, INDEX, CONCAT, AND, OR and to which error is
first; tables that need it are bound with ``order``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions.columns import Val
from lattica.functions.interpreter import ARITY
from lattica.operators import ranking
from lattica.plans.formula import Binary, Call, Error, Literal, NameRef, TableRef, Unary, parse, walk

_AGGREGATES = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA")
#: Distinct keys of a lookup table that a broadcast may hold; above it the join shuffles.
BROADCAST_KEYS = 1_000_000


@dataclass
class Bound:
    df: DataFrame
    headers: list[str]
    order: list[str]
    vals: dict[str, Val] = field(default_factory=dict)
    placed: DataFrame | None = None

    def positioned(self) -> DataFrame:
        """The table with each row's place in its order (column __pos)."""
        if self.placed is None:
            if not self.order:
                raise ValueError("a formula needs the order of a table bound without one")
            self.placed = ranking.positions(self.df, self.order)
        return self.placed


class Book:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Bound] = {}
        self.names: dict[str, TableRef] = {}

    def bind(self, name: str, df: DataFrame, order: list[str] | None = None) -> Bound:
        found = Bound(df, df.columns, order or [])
        for f in df.schema:
            try:
                found.vals[f.name] = C.from_column(f.name, f.dataType, f.nullable)
            except TypeError:
                continue  # a column of a kind that formulas lack: its header is unknown to them
        self.tables[name] = found
        return found

    def name(self, alias: str, target: str) -> None:
        """A workbook name for a table column or region."""
        self.names[alias] = parse(target)

    def fill(self, table: str, header: str, formula: str) -> None:
        """Add a column: the formula's value and, if it can fail, its error."""
        bound = self.tables[table]
        tree = parse(formula)
        rows = Rows(self, table)
        value = rows.scalar(tree)
        df = rows.joined(bound.df)
        kinds = sorted(k for k in value.cols if k != "blank")
        added = {f"__{k}_{header}": value.cols[k] for k in kinds}
        if len(value.cols) > 1:
            added[f"__kind_{header}"] = value.kind
        if value.err is not None:
            added[f"__err_{header}"] = value.err
        df = df.withColumns(added)
        own = {k: F.col(f"`__{k}_{header}`") if k != "blank" else None for k in value.cols}
        kind = F.col(f"`__kind_{header}`") if len(value.cols) > 1 else value.kind
        bound.vals[header] = Val(own, kind, F.col(f"`__err_{header}`") if value.err is not None else None)
        bound.df, bound.placed = df.drop(*rows.temporary), None
        bound.headers = [*bound.headers, header]

    def value(self, table: str, header: str) -> tuple[Column, Column]:
        """(payload, error) of a column with one kind."""
        v = self.tables[table].vals[header]
        return v.native(), v.error()

    def table(self, table: str, **wanted: str) -> DataFrame:
        """Columns of the table by alias=header; an alias ending in _err gives the header's error."""
        out = [(self.value(table, h)[1] if alias.endswith("_err") else self.value(table, h)[0]).alias(alias) for alias, h in wanted.items()]
        return self.tables[table].df.select(*out)

    def scalars(self, **formulas: str) -> DataFrame:
        """One row with each formula's payload under its alias, and its error under alias_err."""
        whole = Whole(self)
        vals = {alias: whole.scalar(parse(f)) for alias, f in formulas.items()}
        frame = whole.frame()
        out = []
        for alias, v in vals.items():
            out += [v.native().alias(alias), v.error().alias(f"{alias}_err")]
        return frame.select(*out)


class Compiler:
    """Expressions common to rows and whole tables."""

    def __init__(self, book: Book):
        self.book = book

    def resolve(self, ref) -> TableRef | None:
        return self.book.names.get(ref.name) if isinstance(ref, NameRef) else ref

    def scalar(self, node) -> Val:
        match node:
            case Literal(value=Error(token=t)):
                return C.fail(t)
            case Literal(value=v):
                return C.literal(v)
            case NameRef():
                return C.fail("#VALUE!" if node.name in self.book.names else "#NAME?")
            case TableRef(current_row=True):
                return self.current(node)
            case TableRef():
                return C.fail("#VALUE!")
            case Unary(op=op, operand=x):
                return C.unary(op, self.scalar(x))
            case Binary(op=op, left=a, right=b):
                x, y = self.scalar(a), self.scalar(b)
                if op == "&":
                    return C.concat(x, y)
                return C.compare(op, x, y) if op in ("=", "<>", "<", "<=", ">", ">=") else C.arithmetic(op, x, y)
            case Call(name=n, args=args):
                if n not in ARITY:
                    return C.fail("#NAME?")
                least, most = ARITY[n]
                if not least <= len(args) <= most:
                    return C.fail("#VALUE!")
                if n in _AGGREGATES:
                    return self.aggregate(n, args)
                return getattr(self, "f_" + n)(*args)
        return C.fail("#REF!")

    def current(self, node: TableRef) -> Val:
        return C.fail("#REF!")

    def aggregate(self, name: str, args: tuple) -> Val:
        """Aggregates of scalar arguments; ranges are for Whole."""
        vals = [self.scalar(a) for a in args]
        if name == "COUNTA":
            return C.of("number", sum((F.when(~v.is_kind("blank") | v.error().isNotNull(), 1.0).otherwise(0.0) for v in vals), F.lit(0.0)))
        err = C.first_error(*(v.err for v in vals))
        nums = [F.when(v.is_kind("number"), v.cols["number"]) for v in vals if "number" in v.cols]
        n = sum((F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in nums), F.lit(0.0))
        total = sum((F.coalesce(x, F.lit(0.0)) for x in nums), F.lit(0.0))
        ends = {"MIN": F.least, "MAX": F.greatest}.get(name)
        edge = F.lit(None).cast("double") if not nums else nums[0] if len(nums) == 1 else ends(*nums) if ends else None
        return self.finish(name, total, n, edge, err)

    @staticmethod
    def finish(name: str, total: Column, n: Column, edge: Column, err: Column | None) -> Val:
        match name:
            case "SUM":
                return C.finite(total, err)
            case "COUNT":
                return C.of("number", n, err)
            case "AVERAGE":
                return C.finite(F.try_divide(total, n), err, F.when(n == 0, F.lit("#DIV/0!")))
        return C.of("number", edge, C.first_error(err, F.when(n == 0, F.lit("#VALUE!"))))

    def f_IF(self, c, a, b) -> Val:
        cond, err = C.logical(self.scalar(c))
        return C.choose(F.coalesce(cond, F.lit(False)), self.scalar(a), self.scalar(b), err)

    def f_IFERROR(self, v, other) -> Val:
        x = self.scalar(v)
        if x.err is None:
            return x
        good = Val(x.cols, x.kind)
        return C.choose(x.err.isNull(), good, self.scalar(other), None) if x.cols else self.scalar(other)

    def _first(self, args, decisive: bool) -> Val:
        out, err, open_ = F.lit(not decisive), None, F.lit(True)
        for a in args:
            x, e = C.logical(self.scalar(a))
            if e is not None:
                err = C.first_error(err, F.when(open_, e))
                open_ = open_ & e.isNull()
            hit = open_ & F.coalesce(x == decisive, F.lit(False))
            out = F.when(hit, decisive).otherwise(out)
            open_ = open_ & ~hit
        return C.of("boolean", out, err)

    def f_AND(self, *args) -> Val:
        return self._first(args, False)

    def f_OR(self, *args) -> Val:
        return self._first(args, True)

    def f_NOT(self, a) -> Val:
        x, err = C.logical(self.scalar(a))
        return C.of("boolean", ~x, err)

    def f_ABS(self, a) -> Val:
        x, err = C.number(self.scalar(a))
        return C.of("number", F.abs(x), err)

    def f_INT(self, a) -> Val:
        x, err = C.number(self.scalar(a))
        return C.of("number", F.when(F.rint(x) == x, x).otherwise(F.floor(x).cast("double")), err)

    def f_MOD(self, a, b) -> Val:
        (x, ex), (y, ey) = C.number(self.scalar(a)), C.number(self.scalar(b))
        q = F.try_divide(x, y)
        down = F.when(F.rint(q) == q, q).otherwise(F.floor(q).cast("double"))
        return C.finite(x - y * down, ex, ey, F.when(y == 0, F.lit("#DIV/0!")))

    def _round(self, a, digits, how: str) -> Val:
        x, err = C.number(self.scalar(a))
        n = self.constant(digits)
        if n is None or n != int(n):
            raise NotImplementedError("digits must be a whole constant in a compiled formula")
        return C.finite(C.exact_round(x, int(n), how), err)

    def constant(self, node) -> float | None:
        match node:
            case Literal(value=float(v)):
                return v
            case Unary(op=op, operand=Literal(value=float(v))):
                return -v if op == "-" else v
        return None

    def f_ROUND(self, a, d) -> Val:
        return self._round(a, d, "ROUND")

    def f_ROUNDUP(self, a, d) -> Val:
        return self._round(a, d, "ROUNDUP")

    def f_ROUNDDOWN(self, a, d) -> Val:
        return self._round(a, d, "ROUNDDOWN")

    def f_LEN(self, a) -> Val:
        s, err = C.text(self.scalar(a))
        return C.of("number", F.length(s).cast("double"), err)

    def f_LOWER(self, a) -> Val:
        s, err = C.text(self.scalar(a))
        return C.of("text", F.translate(s, C.UPPER, C.LOWER), err)

    def f_UPPER(self, a) -> Val:
        s, err = C.text(self.scalar(a))
        return C.of("text", F.translate(s, C.LOWER, C.UPPER), err)

    def f_TRIM(self, a) -> Val:
        s, err = C.text(self.scalar(a))
        return C.of("text", F.regexp_replace(F.regexp_replace(s, "^ +| +$", ""), " +", " "), err)

    def _count(self, node) -> tuple[Column, Column | None]:
        n, err = C.number(self.scalar(node))
        own = None if (self.constant(node) or -1) >= 0 and self.constant(node) == int(self.constant(node)) else F.when((n < 0) | (n != F.rint(n)), F.lit("#NUM!"))
        return F.least(n, F.lit(2.0**31 - 1)).cast("int"), C.first_error(err, own)

    def f_LEFT(self, a, n=Literal(1.0)) -> Val:
        (s, es), (k, ek) = C.text(self.scalar(a)), self._count(n)
        return C.of("text", F.when(k > 0, F.left(s, k)).otherwise(""), C.first_error(es, ek))

    def f_RIGHT(self, a, n=Literal(1.0)) -> Val:
        (s, es), (k, ek) = C.text(self.scalar(a)), self._count(n)
        return C.of("text", F.when(k > 0, F.right(s, k)).otherwise(""), C.first_error(es, ek))

    def f_MID(self, a, start, n) -> Val:
        (s, es), (first, ef), (k, ek) = C.text(self.scalar(a)), self._count(start), self._count(n)
        low = F.when(first < 1, F.lit("#NUM!"))
        return C.of("text", F.when((k > 0) & (first > 0), F.substring(s, first, k)).otherwise(""), C.first_error(es, ef, low, ek))

    def f_CONCAT(self, *args) -> Val:
        parts = [C.text(self.scalar(a)) for a in args]
        return C.of("text", F.concat(*(s for s, _ in parts)), C.first_error(*(e for _, e in parts)))

    def header(self, a, r, c=None) -> Val | None:
        """INDEX of a table's headers, which are one row."""
        ref = self.resolve(a)
        if not isinstance(ref, TableRef) or ref.selector != "#Headers" or ref.table not in self.book.tables:
            return None
        headers = self.book.tables[ref.table].headers
        at, row = (self.constant(r), 1) if c is None else (self.constant(c), self.constant(r))
        if at is None or row is None:
            raise NotImplementedError("INDEX of headers takes constant places")
        fine = row == 1 and 1 <= at <= len(headers) and int(at) == at
        return C.literal(headers[int(at) - 1]) if fine else C.fail("#REF!")

    def f_INDEX(self, *args) -> Val:
        raise NotImplementedError("INDEX of a table is compiled as INDEX(column, MATCH(...)) in rows, or over whole tables")

    f_MATCH = f_INDEX

    def f_DATE(self, y, m, d) -> Val:
        parts = [C.number(self.scalar(x)) for x in (y, m, d)]
        spelled = F.concat_ws("-", *(F.lpad(F.when(x == F.rint(x), F.when((x >= 0) & (x < 10_000), x).cast("int")).cast("string"), n, "0") for (x, _), n in zip(parts, (4, 2, 2), strict=True)))
        day = F.when(F.length(spelled) == 10, F.try_to_date(spelled, "yyyy-MM-dd"))
        day = F.when(parts[0][0] >= 1, day)
        return C.of("date", day, C.first_error(*(e for _, e in parts), F.when(day.isNull(), F.lit("#NUM!"))))

    def _part(self, a, part) -> Val:
        v = self.scalar(a)
        cols = {k: c for k, c in v.cols.items() if k in ("date", "datetime")}
        if not cols:
            return C.fail("#VALUE!") if v.err is None else C.fail(C.first_error(v.err, F.lit("#VALUE!")))
        wrong = F.when(~v.kind.isin(*cols), F.lit("#VALUE!")) if len(v.cols) > len(cols) else None
        return C.of("number", F.coalesce(*(part(c) for c in cols.values())).cast("double"), C.first_error(v.err, wrong))

    def f_YEAR(self, a) -> Val:
        return self._part(a, F.year)

    def f_MONTH(self, a) -> Val:
        return self._part(a, F.month)

    def f_DAY(self, a) -> Val:
        return self._part(a, F.dayofmonth)

    def _is(self, a, kind: str) -> Val:
        v = self.scalar(a)
        if kind == "error":
            return C.of("boolean", v.error().isNotNull())
        return C.of("boolean", v.is_kind(kind) & v.error().isNull() if v.cols else F.lit(False))

    def f_ISBLANK(self, a) -> Val:
        return self._is(a, "blank")

    def f_ISNUMBER(self, a) -> Val:
        return self._is(a, "number")

    def f_ISTEXT(self, a) -> Val:
        return self._is(a, "text")

    def f_ISERROR(self, a) -> Val:
        return self._is(a, "error")


class Rows(Compiler):
    """A formula evaluated in each data row of a table."""

    def __init__(self, book: Book, table: str):
        super().__init__(book)
        self.own, self.joins, self.temporary = table, [], []

    def current(self, node: TableRef) -> Val:
        if node.table not in (None, self.own):
            return C.fail("#REF!")
        return self.book.tables[self.own].vals.get(node.selector) or C.fail("#REF!")

    def joined(self, df: DataFrame) -> DataFrame:
        for make in self.joins:
            df = make(df)
        return df

    def aggregate(self, name: str, args: tuple) -> Val:
        if not any(isinstance(n, (TableRef, NameRef)) and not getattr(n, "current_row", False) for a in args for n in walk(a)):
            return super().aggregate(name, args)
        whole = Whole(self.book)
        v, alias = whole.aggregate(name, args), f"__w{len(self.joins)}_{name}"
        one = whole.frame().select(v.cols["number"].alias(alias), v.error().alias(f"{alias}_err"))
        self.joins.append(lambda df: df.crossJoin(F.broadcast(one)))  # a single row
        self.temporary += [alias, f"{alias}_err"]
        return C.of("number", F.col(alias), F.col(f"{alias}_err"))

    def _lookup(self, wanted: Val, ref, give: str | None) -> Val:
        """The first row of ref's table whose column equals wanted: its place, or its value of column ``give``.

        Keys are deduplicated before the join, so it keeps the rows as they are.
        """
        ref = self.resolve(ref)
        there = self.book.tables.get(ref.table) if isinstance(ref, TableRef) else None
        if there is None or ref.selector not in there.vals:
            return C.fail("#REF!")
        key = there.vals[ref.selector]
        kinds = [k for k in key.cols if k in wanted.cols and k != "blank"]
        if not kinds:
            return C.fail(C.first_error(wanted.err, F.lit("#N/A")))
        (kind,) = kinds
        k, at = len(self.joins), F.col("__pos") if give is None else F.struct(*there.order)
        source = there.positioned() if give is None else there.df
        value = C.of("number", F.col("__pos").cast("double")) if give is None else there.vals[give]
        (payload,) = [p for p in value.cols if p != "blank"]
        got = F.struct(value.native().alias("v"), value.error().alias("e"), F.lit(True).alias("hit"))
        first = source.where(key.is_kind(kind)).groupBy(key.cols[kind].alias(f"__k{k}")).agg(F.min_by(got, at).alias(f"__l{k}"))
        mine = F.when(wanted.is_kind(kind), wanted.cols[kind])

        def join(df: DataFrame) -> DataFrame:
            few = first.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
            return df.join(F.broadcast(first) if few else first, mine == F.col(f"__k{k}"), "left")

        self.joins.append(join)
        self.temporary += [f"__k{k}", f"__l{k}"]
        found = F.col(f"__l{k}")
        err = C.first_error(wanted.err, F.when(found["hit"].isNull(), F.lit("#N/A")), found["e"])
        if "blank" in value.cols:
            return Val({payload: found["v"], "blank": None}, F.when(found["v"].isNull(), "blank").otherwise(payload), err)
        return C.of(payload, found["v"], err)

    def f_MATCH(self, v, a, mode=Literal(0.0)) -> Val:
        if self.constant(mode) != 0:
            return C.fail("#VALUE!")
        return self._lookup(self.scalar(v), a, None)

    def f_INDEX(self, a, r, c=None) -> Val:
        header = self.header(a, r, c)
        if header is not None:
            return header
        area = self.resolve(a)
        if c is None and isinstance(area, TableRef) and isinstance(r, Call) and r.name == "MATCH":
            inner = self.resolve(r.args[1])
            if isinstance(inner, TableRef) and inner.table == area.table and (len(r.args) == 2 or self.constant(r.args[2]) == 0):
                return self._lookup(self.scalar(r.args[0]), inner, area.selector)
        return super().f_INDEX(a, r, c)


class Whole(Compiler):
    """A formula over whole tables; its aggregates become one row."""

    def __init__(self, book: Book):
        super().__init__(book)
        self.wanted: dict[tuple[str, bool], list[Column]] = {}
        self.count = 0

    def frame(self) -> DataFrame:
        """One row with all aggregates: a scan of each table, put side by side."""
        out = None
        for (table, placed), exprs in self.wanted.items():
            bound = self.book.tables[table]
            one = (bound.positioned() if placed else bound.df).agg(*exprs)
            out = one if out is None else out.crossJoin(F.broadcast(one))  # single rows
        return out if out is not None else self.book.spark.range(1)

    def _ask(self, table: str, expr: Column, placed: bool = False) -> Column:
        alias = f"__a{self.count}"
        self.count += 1
        self.wanted.setdefault((table, placed), []).append(expr.alias(alias))
        return F.col(alias)

    def _range(self, node) -> tuple[str, list[Val]] | Val:
        ref = self.resolve(node)
        if ref is None:
            return C.fail("#NAME?")
        bound = self.book.tables.get(ref.table)
        if bound is None:
            return C.fail("#REF!")
        if ref.selector == "#Data":
            return ref.table, [bound.vals[h] for h in bound.headers if h in bound.vals]
        if ref.selector not in bound.vals:
            return C.fail("#REF!")
        return ref.table, [bound.vals[ref.selector]]

    def aggregate(self, name: str, args: tuple) -> Val:
        total, n, edges, errs, filled = F.lit(0.0), F.lit(0.0), [], [], F.lit(0.0)
        for a in args:
            is_range = isinstance(a, (NameRef, TableRef)) and not getattr(a, "current_row", False)
            ref = self.resolve(a) if is_range else None
            if is_range and ref is not None and ref.selector == "#Headers" and ref.table in self.book.tables:
                filled = filled + float(len(self.book.tables[ref.table].headers))
                continue
            found = self._range(a) if is_range else self.scalar(a)
            if isinstance(found, Val):
                errs.append(found.err)
                filled = filled + F.when(~found.is_kind("blank") | found.error().isNotNull(), 1.0).otherwise(0.0)
                if "number" in found.cols:
                    x = F.when(found.is_kind("number") & found.error().isNull(), found.cols["number"])
                    total, n = total + F.coalesce(x, F.lit(0.0)), n + F.when(x.isNotNull(), 1.0).otherwise(0.0)
                    edges.append(x)
                continue
            table, vals = found
            bound = self.book.tables[table]
            for v in vals:
                if name == "COUNTA":
                    filled = filled + self._ask(table, F.count(F.when(~v.is_kind("blank") | v.error().isNotNull(), 1))).cast("double")
                    continue
                if v.err is not None:
                    place = F.when(v.err.isNotNull(), F.struct(*bound.order) if bound.order else v.err)
                    errs.append(self._ask(table, F.min_by(v.err, place)))
                if "number" not in v.cols:
                    continue
                x = F.when(v.is_kind("number") & v.error().isNull(), v.cols["number"])
                if name in ("SUM", "AVERAGE"):
                    total = total + F.coalesce(self._ask(table, F.sum(x)), F.lit(0.0))
                if name != "SUM":
                    n = n + self._ask(table, F.count(x)).cast("double")
                if name in ("MIN", "MAX"):
                    edges.append(self._ask(table, F.min(x) if name == "MIN" else F.max(x)))
        if name == "COUNTA":
            return C.of("number", filled)
        edge = F.lit(None).cast("double") if not edges else edges[0] if len(edges) == 1 else (F.least if name == "MIN" else F.greatest)(*edges)
        return self.finish(name, total, n, edge, C.first_error(*errs))

    def f_CONCAT(self, *args) -> Val:
        parts = []
        for a in args:
            if not isinstance(a, (NameRef, TableRef)):
                parts.append(C.text(self.scalar(a)))
                continue
            found = self._range(a)
            if isinstance(found, Val):
                parts.append(C.text(found))
                continue
            table, vals = found
            texts = [C.text(v) for v in vals]
            line = F.concat(*(s for s, _ in texts))
            rows = F.array_sort(F.collect_list(F.struct(*self.book.tables[table].order, line.alias("__s"))))  # the result itself is as long
            parts.append((F.array_join(F.transform(self._ask(table, rows), lambda r: r["__s"]), ""), None))
        return C.of("text", F.concat(*(s for s, _ in parts)), C.first_error(*(e for _, e in parts)))

    def _first(self, args, decisive: bool) -> Val:
        vals = []
        for a in args:
            if not isinstance(a, (NameRef, TableRef)):
                return super()._first(args, decisive)
            table, found = self._range(a)
            x, e = C.logical(found[0])
            at = F.struct(*self.book.tables[table].order)
            hit = self._ask(table, F.min(F.when(F.coalesce(x == decisive, F.lit(False)) & (F.lit(True) if e is None else e.isNull()), at)))
            if e is None:
                vals.append((hit.isNotNull(), None))
                continue
            bad = self._ask(table, F.min(F.when(e.isNotNull(), at)))
            token = self._ask(table, F.min_by(e, F.when(e.isNotNull(), at)))
            vals.append((hit.isNotNull(), F.when(bad.isNotNull() & (hit.isNull() | (bad < hit)), token)))
        out, err = F.lit(not decisive), None
        for hit, e in reversed(vals):
            out = F.when(hit, decisive).otherwise(out)
            err = F.when(hit if e is None else hit & e.isNull(), F.lit(None).cast("string")).otherwise(C.first_error(e, err) if C.first_error(e, err) is not None else F.lit(None).cast("string"))
        return C.of("boolean", out, err)

    def f_MATCH(self, v, a, mode=Literal(0.0)) -> Val:
        found = self._range(a)
        if isinstance(found, Val) or self.constant(mode) != 0:
            return found if isinstance(found, Val) else C.fail("#VALUE!")
        table, (key,) = found
        wanted = self.scalar(v)
        kinds = [k for k in key.cols if k in wanted.cols and k != "blank"]
        if not kinds:
            return C.fail(C.first_error(wanted.err, F.lit("#N/A")))
        at = self._ask(table, F.min(F.when(key.is_kind(kinds[0]) & (key.cols[kinds[0]] == wanted.cols[kinds[0]]), F.col("__pos"))), placed=True)
        return C.of("number", at.cast("double"), C.first_error(wanted.err, F.when(at.isNull(), F.lit("#N/A"))))

    def f_INDEX(self, a, r, c=None) -> Val:
        header = self.header(a, r, c)
        if header is not None:
            return header
        found = self._range(a)
        if isinstance(found, Val):
            return found
        table, vals = found
        row, col = self.constant(r), 1.0 if c is None else self.constant(c)
        if row is None or col is None:
            return super().f_INDEX(a, r, c)
        if len(vals) > 1 and c is None:
            return C.fail("#VALUE!")
        if row < 1 or col < 1 or col > len(vals):
            return C.fail("#REF!")
        v = vals[int(col) - 1]
        here = F.col("__pos") == int(row)
        there = self._ask(table, F.max(here), placed=True)
        err = C.first_error(F.when(~F.coalesce(there, F.lit(False)), F.lit("#REF!")), self._ask(table, F.max(F.when(here, v.error())), placed=True))
        cols = {k: None if k == "blank" else self._ask(table, F.max(F.when(here, x)), placed=True) for k, x in v.cols.items()}
        kind = v.kind if len(cols) == 1 else self._ask(table, F.max(F.when(here, v.kind)), placed=True)
        return Val(cols, kind, err)
