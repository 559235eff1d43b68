from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.functions.interpreter import Evaluator, Range
from lattica.functions.values import DateTime, Err, infer, spell_field, spell_number
from lattica.plans.formula import FormulaError, canonical, parse, shifted

CANONICAL = [
    ("=1+2*3^-2", "1+2*3^-2"), ("=-2^2", "-2^2"), ("=(-2)^2", "(-2)^2"), ("=((1))+(2*3)", "1+2*3"), ("=1-(2-3)", "1-(2-3)"), ("=2^3^2", "2^3^2"), ("=(2^3)^2", "(2^3)^2"),
    ("=sum( a1 , $b$2:C3 )", "SUM(A1,$B$2:C3)"), ("=t[Unit Cost]", "t[Unit Cost]"), ("=[@a]]b]", "[@a]]b]"), ("=t[#Data]", "t[#Data]"), ('="a""b"', '"a""b"'),
    ("=true", "TRUE"), ("=1000", "1e3"), ("=in_1!A1:B2", "in_1!A1:B2"), ("=rate*2", "rate*2"), ("=#N/A", "#N/A"), ("=LOG10(1)", "LOG10(1)"), ("=(1=2)=3", "(1=2)=3"),
]


@pytest.mark.parametrize(("text", "want"), CANONICAL)
def test_canonical_text(text, want):
    assert canonical(parse(text)) == want
    assert canonical(parse(want)) == want


@pytest.mark.parametrize("text", ["=", "=1<2<3", "=1+", '="a', "=00123", "=A1:", "=SUM(1,)", "=SUM(1", "=[Cost]", "=1 2", "=a!b", "= 1", "=" + "(" * 300 + "1" + ")" * 300])
def test_malformed_formulas(text):
    with pytest.raises(FormulaError):
        parse(text)


VALUES = [
    ("2^-2", 0.25), ("0^0", 1.0), ("0^-1", Err("#DIV/0!")), ("(-8)^0.5", Err("#NUM!")), ("1e300*1e300", Err("#NUM!")), ("1/0", Err("#DIV/0!")), ('1+"a"', Err("#VALUE!")), ("A9+TRUE", 1.0),
    ('1000&"x"', "1e3x"), ('"a"="A"', False), ('1="1"', False), ("A9=A8", True), ('A9=""', False), ('1<"a"', Err("#VALUE!")), ("FALSE<TRUE", True), ("#N/A+1/0", Err("#N/A")), ("A1:A3", Err("#VALUE!")),
    ("SUM(A1:A4)", 6.0), ("SUM(TRUE,1)", 1.0), ("AVERAGE(A4)", Err("#DIV/0!")), ("MIN(A4)", Err("#VALUE!")), ("COUNT(A1:A5)", Err("#DIV/0!")), ("COUNTA(A1:A5,A9)", 5.0), ("MAX(A1:A3,9)", 9.0),
    ("IF(TRUE,1,1/0)", 1.0), ("SUM(IF(TRUE,A1:A3,0))", 6.0), ("IF(A4,1,2)", Err("#VALUE!")), ("IFERROR(A5,7)", 7.0), ("AND(FALSE,A5)", False), ("OR(A5,TRUE)", Err("#DIV/0!")), ("NOT(0)", True),
    ("ROUND(2.675,2)", 2.67), ("ROUND(-2.5,0)", -3.0), ("ROUNDUP(1.21,1)", 1.3), ("ROUNDDOWN(-1.29,1)", -1.2), ("ROUND(1,0.5)", Err("#NUM!")), ("INT(-1.5)", -2.0), ("MOD(5,-3)", -1.0), ("MOD(5,0)", Err("#DIV/0!")),
    ('LEFT("\U0001f600éa",2)', "\U0001f600é"), ('RIGHT("abc",2)', "bc"), ('MID("abc",2,9)', "bc"), ('MID("abc",0,1)', Err("#NUM!")), ('LEFT("a",-1)', Err("#NUM!")), ('UPPER("straßeé")', "STRAßEé"), ('TRIM("  a  b ")', "a b"), ("LEN(12.5)", 4.0),
    ("INDEX(A1:A3,2)", 2.0), ("INDEX(A1:A3,4)", Err("#REF!")), ("INDEX(A1:B3,1)", Err("#VALUE!")), ("INDEX(A1:B3,2,1)", 2.0), ("MATCH(3,A1:A5,0)", 3.0), ("MATCH(9,A1:A3)", Err("#N/A")), ("MATCH(9,A1:A5)", Err("#DIV/0!")), ("MATCH(1,A1:A3,1)", Err("#VALUE!")),
    ("DATE(2024,2,29)", date(2024, 2, 29)), ("DATE(2026,2,30)", Err("#NUM!")), ("YEAR(DATE(2024,2,29))", 2024.0), ("DAY(1)", Err("#VALUE!")), ("ISERROR(1/0)", True), ("ISBLANK(A9)", True), ('ISTEXT("")', True), ("NOPE(1)", Err("#NAME?")), ("ABS(1,2)", Err("#VALUE!")),
]
CELLS = {(1, 1): 1.0, (2, 1): 2.0, (3, 1): 3.0, (4, 1): "text", (5, 1): Err("#DIV/0!")}


def _read(ref):
    end = ref.end or ref.start
    got = tuple(CELLS.get((r, c)) for r in range(ref.start.row, end.row + 1) for c in range(ref.start.col, end.col + 1))
    return Range(end.row - ref.start.row + 1, end.col - ref.start.col + 1, got) if ref.end else got[0]


@pytest.mark.parametrize(("text", "want"), VALUES)
def test_values(text, want):
    got = Evaluator(_read).result(parse(text))
    assert type(got) is type(want) and got == want


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_spelling_reads_back(x):
    text = spell_number(x)
    assert float(text) == x and str(float(text)) == str(x)
    assert infer(text) == x


@pytest.mark.parametrize(("x", "want"), [(1e20, "1e20"), (12.5, "12.5"), (-0.0, "-0"), (1000.0, "1e3"), (100.0, "100"), (0.001, "1e-3"), (1500.0, "1500"), (1.23e-10, "1.23e-10"), (0.05, "0.05")])
def test_number_spelling(x, want):
    assert spell_number(x) == want


@given(st.text(max_size=12))
def test_text_fields_read_back(s):
    assert infer(spell_field(s)) == s


def test_inference_and_datetimes():
    assert infer("2026-08-16T10:30:00-04:00") == DateTime(1786890600 * 10**9, -14400)
    assert infer("2026-08-16T10:30:00-04:00").spell() == "2026-08-16T10:30:00-04:00"
    assert infer("2026-08-16T14:30:00Z") != infer("2026-08-16T10:30:00-04:00")
    assert infer("2026-02-30") == "2026-02-30" and infer("00123") == "00123" and infer("'") == ""


def test_fill_shift():
    assert canonical(shifted(parse("A1+$A1+A$1+$A$1"), 1, 2)) == "B3+$A3+B$1+$A$1"
    assert canonical(shifted(parse("A1+B2"), -1, 0)) == "#REF!+A2"
