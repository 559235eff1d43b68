import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions.interpreter import Evaluator
from lattica.functions.values import Err, exact_round, spell_number
from lattica.plans.book import Book
from lattica.plans.formula import Binary, Call, Literal, TableRef, Unary, canonical, parse

NUMBERS = [0.0, -0.0, 1.0, -1.5, 2.675, 1.005, 0.15, 1e300, 2.0**53, 123456.789, -7.0, 0.1, 1e21, 1e-7, 12000.0, 999.5, 0.5, 2.5, 1e22, 123.456e5, 4.35, -2.5e-5]


def test_number_spelling_and_rounding_in_sql(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    for r in df.select("x", C.spell_number(F.col("x")).alias("s")).collect():
        assert r.s == spell_number(r.x)
    for digits in (-2, 0, 1, 2, 5):
        for how in ("ROUND", "ROUNDUP", "ROUNDDOWN"):
            for r in df.where("abs(x) < 1e15").select("x", C.exact_round(F.col("x"), digits, how).alias("y")).collect():
                want = exact_round(r.x, digits, how)
                assert r.y == want and math.copysign(1, r.y) == math.copysign(1, want), (r.x, digits, how)


def _formula(rng, depth):
    if depth == 0:
        return rng.choice([TableRef(None, "n", True), TableRef(None, "m", True), TableRef(None, "s", True), TableRef(None, "b", True), Literal(float(rng.randrange(-3, 4)) if rng.random() < 0.8 else 2.5), Literal(rng.choice(["", "ab", "x"])), Literal(rng.random() < 0.5)])
    one = lambda: _formula(rng, rng.randrange(depth))
    pick = rng.randrange(12)
    if pick < 5:
        node = Binary(rng.choice(["+", "-", "*", "/", "&", "=", "<>", "<", ">=", "^"]), one(), one())
    elif pick == 5:
        node = Unary(rng.choice("+-"), one())
    elif pick == 6:
        node = Call("IF", (one(), one(), one()))
    elif pick == 7:
        node = Call("IFERROR", (one(), one()))
    elif pick == 8:
        node = Call(rng.choice(["AND", "OR"]), (one(), one()))
    elif pick == 9:
        node = Call(rng.choice(["LEN", "UPPER", "TRIM", "INT", "ABS", "NOT", "ISERROR", "ISBLANK", "ISTEXT", "ISNUMBER"]), (one(),))
    elif pick == 10:
        node = Call(rng.choice(["SUM", "COUNT", "COUNTA", "MAX", "AVERAGE"]), (one(), one()))
    else:
        node = Call("MOD", (one(), one()))
    return node


ROWS = [(1.0, None, "ab", True), (-2.0, 0.0, None, False), (0.0, 3.5, "", None), (2.5, -1.0, " x  y ", True)]


def test_compiled_formulas_agree_with_the_interpreter(spark):
    rng, df = random.Random(11), spark.createDataFrame(ROWS, "n double, m double, s string, b boolean").coalesce(1)
    nodes = [_formula(rng, 3) for _ in range(60)]
    book = Book(spark)
    book.bind("t", df)
    wanted = []
    for node in nodes:
        assert parse(canonical(node)) is not None
        from lattica.plans.book import Rows

        v = Rows(book, "t").scalar(node)
        kind = F.when(v.error().isNotNull(), "error").otherwise(v.kind)
        shown = {k: F.when(kind == k, c.cast("string")) for k, c in v.cols.items() if k != "blank"}
        wanted.append(F.struct(kind.alias("kind"), F.coalesce(v.error(), *shown.values()).alias("text")))
    for a in range(0, len(nodes), 20):
        got = df.select(*(w.alias(f"c{k}") for k, w in enumerate(wanted[a : a + 20]))).collect()
        for row, out in zip(ROWS, got, strict=True):
            values = dict(zip("nmsb", row, strict=True))
            for node, g in zip(nodes[a : a + 20], out, strict=True):
                want = Evaluator(lambda ref: values[ref.selector]).result(node)  # noqa: B023
                if isinstance(want, Err):
                    assert (g.kind, g.text) == ("error", want.token), canonical(node)
                elif want is None:
                    assert g.kind == "blank", canonical(node)
                elif isinstance(want, float):
                    assert g.kind == "number" and float(g.text) == pytest.approx(want, rel=1e-12), canonical(node)
                else:
                    assert g.text == (str(want).lower() if isinstance(want, bool) else want), canonical(node)


def test_lookups_and_errors(spark):
    book = Book(spark)
    book.bind("keys", spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 3.0)], "i int, k string, v double"), ["i"])
    book.bind("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "i int, k string"), ["i"])
    book.fill("t", "m", "=MATCH([@k],keys[k],0)")
    book.fill("t", "v", "=INDEX(keys[v],MATCH([@k],keys[k]))")
    book.fill("t", "gone", "=[@nope]+1")
    rows = book.table("t", m="m", m_err="m", v="v", v_err="v", gone_err="gone").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1.0, None, 1.0, None, "#REF!"), (2.0, None, None, None, "#REF!"), (None, "#N/A", None, "#N/A", "#REF!"), (None, "#N/A", None, "#N/A", "#REF!")], key=str)
    one = book.scalars(a="=COUNTA(t[#Data])", b="=SUM(nope)", c="=SUM(t[nope])", d="=SUM(t[gone])", e="=MATCH(\"b\",keys[k])", f="=CONCAT(keys[k])").first()
    assert (one.b_err, one.c_err, one.d_err, one.e, one.f) == ("#NAME?", "#REF!", "#REF!", 2.0, "aba")
    book.bind("none", spark.createDataFrame([], "x double"), ["x"])
    empty = book.scalars(s="=SUM(none[x])", a="=AVERAGE(none[x])", m="=MAX(none[x])", n="=COUNT(none[x])").first()
    assert (empty.s, empty.a_err, empty.m_err, empty.n) == (0.0, "#DIV/0!", "#VALUE!", 0.0)
