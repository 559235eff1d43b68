import json

import pytest

from lattica.__main__ import main
from lattica.functions.values import infer_strict
from lattica.operators import edits
from lattica.plans.formula import parse_area
from lattica.plans.registry import INSTALLED, Assertions, Limits, Registry, completeness, validate
from lattica.plans.sheets import Calculator
from lattica.sources.workbook import loads

BOOK = '#!lattica 0.1\n@require assertions@1\n@sheet s "S"\n@block A1 csv\n1,=A1+1,"two\nlines",\'\n@end\n'


def _with(*lines, where="sheet"):
    block = "@extension assertions@1\n" + "".join(x + "\n" for x in lines) + "@end\n"
    return loads(BOOK + block if where == "sheet" else BOOK.replace("@sheet", block + "@sheet"))


@pytest.mark.parametrize(
    ("line", "code"),
    [
        ("assert B1 = 2", None), ("assert B1 != 2", "MS3201"), ("assert B1 >= 2", None), ('assert B1 = "2"', "MS3201"), ('assert B1 < "9"', "MS3201"), ('assert C1 = "two\\nlines"', None),
        ("assert E9 = blank", None), ("assert E9 < 1", "MS3201"), ("assert A1:B1 = 1", "MS3202"), ("assert s!A1 = 1", "MS3202"), ("assert A1 = =1", "MS3202"), ("assert A1 = word", "MS3202"),
        ("assert  A1 = 1", "MS3202"), ("", None), ("# x", None), ("x", "MS3202"), ("assert A1 = true", "MS3201"),
    ],
)
def test_assertion(line, code):
    assert [(d.code, d.line) for d in validate(_with(line))] == ([(code, 8 + 1)] if code else [])


def test_assertions_of_the_whole_book_name_their_sheet():
    assert [d.code for d in validate(_with("assert s!A1 = 1", "assert A1 = 1", "assert z!A1 = 1", where="book"))] == ["MS3202", "MS3202"]


def test_limits_are_told():
    book = _with(*["assert A1 = 2"] * 5)
    assert [(d.code, d.line) for d in validate(book, limits=Limits(diagnostics=2))] == [("MS3203", 8), ("MS3201", 9), ("MS3201", 10)]
    assert [d.code for d in validate(book, limits=Limits(lines=3))] == ["MS3203"]


def test_registry_and_completeness():
    with pytest.raises(ValueError):
        Registry(Assertions(), Assertions())
    assert INSTALLED.get("assertions@2") is None
    assert completeness(loads(BOOK)) == (True, True) and completeness(loads(BOOK), Registry()) == (False, False)
    assert completeness(loads(BOOK.replace("@require", "@use")), Registry()) == (True, True)


def test_graph_and_text():
    c = Calculator(loads(BOOK))
    assert c.text(parse_area("s!A1:E1")) == 's!A1:E1\n1\t|\t2\t|\t"two\\nlines"\t|\t""\t|\t<blank>\n'
    assert c.stats() == {"nodes": 2, "edges": 1, "cyclic_cells": 0, "cyclic_components": 0, "dirty": 0, "evaluated": 1}
    c = Calculator(loads(BOOK.replace("1,=A1+1", "=B1,=A1")))
    assert (c.stats()["cyclic_cells"], c.stats()["cyclic_components"]) == (2, 1)


@pytest.mark.parametrize("field", ["2026-02-30", "2026-02-03T25:00:00Z", "2026-02-03T10:00:00"])
def test_strict_fields(field):
    with pytest.raises(ValueError):
        infer_strict(field)
    assert infer_strict(field[:7]) == field[:7]


def test_edits_of_declarations():
    s = edits.Session(BOOK.rstrip("\n"))
    for make, args in ((edits.set_width, ("s", 1, 2, 9.5)), (edits.set_width, ("s", 2, 2, 9.5)), (edits.set_width, ("s", 2, 3, 9.5)), (edits.set_height, ("s", 4, 4, 8.0)), (edits.define_style, ("x", {"bold": True})), (edits.apply_style, ("s", "A1:B2", ["x"]))):
        s.edit(make(s.source, s.book, *args), expected=s.source)
    assert s.source == BOOK.replace("@1\n", "@1\n@style x bold=true\n") + "@column A:B width=9.5\n@column B:C width=9.5\n@row 4 height=8\n@apply A1:B2 x\n"
    for refused, kind in ((lambda: edits.set_width(s.source, s.book, "z", 1, 1, 2.0), "unknown_sheet"), (lambda: edits.set_width(s.source, s.book, "s", 0, 1, 2.0), "geometry"), (lambda: edits.define_style(s.source, s.book, "x", {}), "conflict"), (lambda: edits.apply_style(s.source, s.book, "s", "A1", ["y"]), "unknown_style"), (lambda: edits.set_name(s.source, s.book, "n", "s!A1"), "unknown_name"), (lambda: s.edit([], expected=BOOK), "stale")):
        with pytest.raises(edits.EditError) as e:
            refused()
        assert e.value.kind == kind


def test_fingerprint():
    assert edits.fingerprint("") == (0, 0xCBF29CE484222325) and edits.fingerprint("a") == (1, 0xAF63DC4C8601EC8C)


def test_targets_of_the_command_line(tmp_path, capsys):
    path = tmp_path / "a.txt"
    path.write_text('#!lattica 0.1\n@use assertions@1\n@name two = t[b]\n@name one = s!A2\n@sheet s "S"\n@table t A1 csv\na,b\n1,=[@a]*2\n2,\n@end\n@extension assertions@1\nassert B2 = 3\n@end\n')
    shown = {"s!A1:B1": "s!A1:B1\na\t|\tb\n", "one": "s!A2\n1\n", "two": "s!B2:B3\n2\n<blank>\n", "t": "s!A1:B3\na\t|\tb\n1\t|\t2\n2\t|\t<blank>\n"}
    for target, text in shown.items():
        assert main(["text", str(path), target]) == 0 and capsys.readouterr().out == text
    assert main(["text", str(path), "z!A1"]) == 1 and main(["text", str(path), "nothing"]) == 1
    capsys.readouterr()
    assert main(["check", str(path)]) == 1
    out = json.loads(capsys.readouterr().out)
    assert [d["code"] for d in out["diagnostics"]] == ["MS3201"] and out["calculation_complete"] and not out["valid"]
    assert main(["stats", str(path)]) == 0 and json.loads(capsys.readouterr().out)["evaluated"] == 1
