import pytest

from lattica.functions.values import Err
from lattica.plans.sheets import Calculator
from lattica.sources import workbook as W

GOOD = '''#!lattica 0.1
@style money number=currency currency="USD" decimals=2
@name rate = inputs!B1
@name subs = costs[Sub]
@sheet inputs "In"
@block A1 csv
x,0.5
@end
@table costs A4 csv
Item,Cost,Qty,Sub
"Rent, ""big""",1500,1,
Util,200,3,
@end
@fill costs[Sub] =[@Cost]*[@Qty]
@apply costs[Sub] money
@column A:C width=12
@sheet s "S"
@block A1 csv
=SUM(subs)*(1-rate),=inputs!A1&1000,=B2,=D1
,=C1,,=SUM(A1:B1)
@end
'''


def test_calculation_cycles_and_changes():
    calc = Calculator(W.loads(GOOD))
    got = calc.all_values()
    assert got["s", 1, 1] == 1050.0 and got["s", 1, 2] == "x1e3" and got["inputs", 6, 4] == 600.0
    assert {k for k, v in got.items() if v == Err("#CIRC!")} == {("s", 1, 3), ("s", 2, 2)} | {k for k in got if k == ("s", 1, 4) and got[k] == Err("#CIRC!")}
    assert calc.apply_changes({("inputs", 1, 2): 0.5}) == 0
    assert calc.apply_changes({("inputs", 1, 2): 0.25}) > 0
    assert calc.calculate([("s", 1, 1)]) == {("s", 1, 1): 1575.0}
    fresh = Calculator(W.loads(GOOD.replace("x,0.5", "x,0.25"))).all_values()
    assert calc.all_values() == fresh
    for bad in ({("s", 1, 1): 1.0}, {("nope", 1, 1): 1.0}, {("inputs", 1, 1): float("nan")}):
        with pytest.raises(ValueError):
            calc.apply_changes(bad)


def test_canonical_text_is_stable():
    text = W.dumps(W.loads(GOOD))
    assert W.dumps(W.loads(text)) == text
    assert Calculator(W.loads(text)).all_values() == Calculator(W.loads(GOOD)).all_values()


SHEET = '#!lattica 0.1\n@sheet s "S"\n'


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        (GOOD, []), (GOOD.replace("0.1\n", "0.2\n", 1), ["MS1001"]), ('@sheet s "S"\n', ["MS1001"]), (SHEET + "#!lattica 0.1\n", ["MS1001"]), ("\ufeff" + SHEET, ["MS1001", "MS1002", "MS1101"]),
        (SHEET.encode() + b"# \xff\n", ["MS1003"]), (SHEET + "# a\r# b\r\n", ["MS1004"]), (SHEET + "@block A1 csv\na\rb\n@end\n", ["MS1004"]), ("#!lattica 0.1\n", ["MS1101"]), (SHEET + "@fil A1 =1\n", ["MS1101"]),
        (SHEET + "words\n", ["MS1101"]), (SHEET + '@book locale="x"\n', ["MS1101"]), ('#!lattica 0.1\n@book nope="x"\n@sheet s "S"\n', ["MS1101"]), ("#!lattica 0.1\n@fill A1 =1\n@sheet s \"S\"\n", ["MS1101"]),
        (SHEET + "@block A1 tsv\nx\n@end\n", ["MS1101"]), (SHEET + "@extension a@1\nx\n", ["MS1101"]), (GOOD.replace("x,0.5", 'x,"0.5'), ["MS1102"]), (SHEET + '@block A1 csv\na"b\n@end\n', ["MS1102"]),
        (SHEET + '@sheet Big "B"\n', ["MS1201"]), (SHEET + "@style 9x bold=true\n", ["MS1201"]), (SHEET + "@name true = s!A1\n", ["MS1201"]), (SHEET + '@block A1 csv\nx\n@end\n@apply A1 "h"\n', ["MS1201"]), (SHEET + "@use nothing\n", ["MS1201"]),
        (SHEET + "@block A0 csv\nx\n@end\n", ["MS1202"]), (SHEET + '@column "A" width=3\n', ["MS1202"]), (GOOD.replace("Util,200,3,", "Util,200,3"), ["MS1204", "MS2101"]), (GOOD.replace("@sheet s", "@sheet inputs"), ["MS1301"]),
        (GOOD.replace("@table costs A4", "@table costs A1"), ["MS1302", "MS2101"]), (GOOD.replace("inputs!B1", "nowhere!B1"), ["MS2101"]), (GOOD.replace("[Sub] money", "[Sub] mony"), ["MS2102"]), (SHEET + "@fill t[Sub] =1\n", ["MS2102"]),
        (GOOD.replace("costs[Sub] =", "costs[Item] ="), ["MS2201"]), (GOOD.replace("Item,Cost", "Cost,Cost"), ["MS2201", "MS2101"]), (SHEET + "@style m number=currency\n@row 1 height=0\n", ["MS2201", "MS2201"]), (GOOD.replace("=SUM(subs)", "=SUM(subs"), ["MS2202"]),
        (SHEET + "@require far_away@1\n", ["MS3101"]), (SHEET + "@use far_away@1\n", ["MS3102"]), (SHEET + '@extension far_away@1 "x"\ny\n@end\n', ["MS3103"]), (SHEET + "@require assertions@1\n", []),
    ],
)
def test_diagnostics(text, codes):
    found = [d.code for d in W.loads(text).diagnostics]
    assert all(found.count(c) >= codes.count(c) for c in codes) and (codes or not found)
    if len(text) < 120:  # in a longer text what is missing is missed elsewhere too
        assert set(found) == set(codes)


def test_canonical_text_keeps_all_that_the_text_holds():
    text = (
        '#!lattica 0.1\n# first\n@use far_away@1\n\n@extension far_away@1 "a b"\n  kept   as\nit is\n@end\n@style m decimals=2\n'
        '@sheet s "é"\n# within\n@column A:C width=1234567.5\n@row 7 height=20.123456789\n@extension far_away@1\n@end\n@block B2 csv\n"a",=  1+ 2\n@end\n# last\n'
    )
    assert W.dumps(W.loads(text)) == text.replace(chr(34) + "a" + chr(34), "a")
    assert W.dumps(W.loads(W.dumps(W.loads(text)))) == W.dumps(W.loads(text))


def test_files_as_tables(spark, tmp_path):
    (tmp_path / "a.ms").write_text(GOOD)
    (tmp_path / "b.ms").write_text(GOOD.replace("x,0.5", "x,0.25"))
    rows = W.read(spark, str(tmp_path), calculated=True).where("sheet = 's' and row = 1 and col = 1").collect()
    assert sorted(r.num for r in rows) == [1050.0, 1575.0]
    assert W.read(spark, str(tmp_path)).where("kind = 'formula'").count() == 12
