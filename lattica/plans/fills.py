"""A1-style fills down a table, compiled without expanding cells.

A table stands with its headers in row 1 and its first data row in row 2; the
filled column is the next free one.  The template is written for the first data
row.  A relative reference ``d`` rows away is a join by position; a reference
with a fixed row is one value for all rows; the template ``own cell above + x``
is a running sum.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions.columns import Val
from lattica.operators import ranking
from lattica.plans.book import Book, Compiler
from lattica.plans.formula import Binary, Call, CellRef, Ref, parse, walk

#: Cells of a sliding range at most; each distance is a join.
WIDEST = 64
_SLIDING = ("SUM", "AVERAGE", "COUNT", "MIN", "MAX", "AND", "OR", "CONCAT", "COUNTA")


class _Fill(Compiler):
    def __init__(self, book: Book, table: str, moved: dict, fixed: dict):
        super().__init__(book)
        self.own, self.moved, self.fixed = book.tables[table], moved, fixed

    def scalar(self, node) -> Val:
        if not isinstance(node, Ref):
            return super().scalar(node)
        c = node.start
        if node.end is not None or node.sheet is not None or not 1 <= c.col <= len(self.own.headers):
            return C.fail("#REF!" if node.end is None else "#VALUE!")
        v = self.own.vals[self.own.headers[c.col - 1]]
        (kind,) = [k for k in v.cols if k != "blank"]
        if c.fixed_row:
            got = F.col(self.fixed[node])
            return Val({kind: got, "blank": None}, F.when(got.isNull(), "blank").otherwise(kind))
        d = c.row - 2
        got, at = F.col(self.moved[node]), F.col("__pos") + d
        if d >= 0:
            return Val({kind: got, "blank": None}, F.when(got.isNull(), "blank").otherwise(kind))
        off = F.when(at < 0, F.lit("#REF!"))
        if kind == "text":  # the header above is text too
            return Val({"text": F.when(at == 0, self.own.headers[c.col - 1]).otherwise(got), "blank": None}, F.when((at > 0) & got.isNull(), "blank").otherwise("text"), off)
        return Val({kind: got, "text": F.lit(self.own.headers[c.col - 1]), "blank": None}, F.when(at == 0, "text").when(got.isNull(), "blank").otherwise(kind), off)


def _same_row(node, width: int) -> bool:
    return isinstance(node, Ref) and node.end is None and node.sheet is None and node.start.row == 2 and not node.start.fixed_row and node.start.col <= width


def _running(tree, width: int) -> int | None:
    """The column that the template sums up to each row, if it is one that does."""
    above = Ref(None, CellRef(width + 1, 1))
    match tree:
        case Binary(op="+", left=a, right=b) if a == above and _same_row(b, width):
            return b.start.col
        case Binary(op="+", left=a, right=b) if b == above and _same_row(a, width):
            return a.start.col
        case Call(name="SUM", args=(Ref(sheet=None, start=a, end=b),)) if b is not None:
            if a.col == b.col <= width and (a.row, a.fixed_row, b.row, b.fixed_row) == (2, True, 2, False):
                return a.col
    return None


def _spread(tree):
    """The template with the cells of sliding ranges for the ranges."""
    match tree:
        case Call(name=name, args=args):
            out = []
            for a in args:
                if isinstance(a, Ref) and a.end is not None and name in _SLIDING and not a.start.fixed_row and not a.end.fixed_row:
                    rows, cols = sorted((a.start.row, a.end.row)), sorted((a.start.col, a.end.col))
                    if (rows[1] - rows[0] + 1) * (cols[1] - cols[0] + 1) > WIDEST:
                        raise NotImplementedError("the range is too wide for a fill")
                    out += [Ref(a.sheet, CellRef(c, r)) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)]
                else:
                    out.append(_spread(a))
            return Call(name, tuple(out))
        case Binary(op=op, left=a, right=b):
            return Binary(op, _spread(a), _spread(b))
    return tree


def fill_down(book: Book, table: str, header: str, formula: str) -> None:
    """Add a column from a template with A1 references, written for row 2."""
    bound, tree = book.tables[table], parse(formula)
    width = len(bound.headers)
    summed = _running(tree, width)
    if summed is not None and "number" in bound.vals[bound.headers[summed - 1]].cols:
        running_fill(book, table, header, bound.headers[summed - 1])
        return
    tree = _spread(tree)
    for ref in (n for n in walk(tree) if isinstance(n, Ref)):
        if ref.end is not None or ref.start.col == width + 1 or ref.sheet is not None:
            raise NotImplementedError("a fill down a table reads single cells of its own table's other columns, or one of the templates that sum")
    refs = [n for n in dict.fromkeys(walk(tree)) if isinstance(n, Ref) and n.end is None and 1 <= n.start.col <= len(bound.headers)]
    wanted, fixed, moved, df = {}, {}, {}, bound.df
    for k, ref in enumerate(refs):
        name = bound.headers[ref.start.col - 1]
        native = bound.vals[name].native()
        df = df.withColumn(f"__v_{ref.start.col}", native)
        if ref.start.fixed_row:
            fixed[ref] = f"__f{k}"
        else:
            moved[ref] = f"__m{k}"
            wanted[f"__m{k}"] = (f"__v_{ref.start.col}", ref.start.row - 2)
    df = ranking.shifted(df, bound.order, wanted)
    for ref, alias in fixed.items():
        one = df.agg(F.max(F.when(F.col("__pos") == ref.start.row - 1, F.col(f"__v_{ref.start.col}"))).alias(alias))
        df = df.crossJoin(F.broadcast(one))  # a single row
    v = _Fill(book, table, moved, fixed).scalar(tree)
    df = df.withColumns({f"__n_{header}": v.native(), f"__err_{header}": v.error()})
    (kind,) = [k for k in v.cols if k != "blank"]
    bound.df, bound.placed = df.drop(*moved.values(), *fixed.values(), "__pos", *(c for c in df.columns if c.startswith("__v_"))), None
    got = F.col(f"`__n_{header}`")
    bound.vals[header] = Val({kind: got, "blank": None}, F.when(got.isNull(), "blank").otherwise(kind), F.col(f"`__err_{header}`"))
    bound.headers = [*bound.headers, header]


def running_fill(book: Book, table: str, header: str, addend: str) -> None:
    """Add the column ``own cell above + addend`` (a header of numbers), blank standing above the first row."""
    bound = book.tables[table]
    bound.df = ranking.running_sum(bound.df, bound.order, F.coalesce(bound.vals[addend].native(), F.lit(0.0)), f"__n_{header}")
    bound.placed = None
    bound.vals[header] = C.of("number", F.col(f"`__n_{header}`"))
    bound.headers = [*bound.headers, header]


