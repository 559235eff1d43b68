import json

import pytest

from lattica.__main__ import main
from lattica.operators import edits
from lattica.sources import csvfile
from lattica.sources.workbook import loads

TEXT = '#!lattica 0.1\n# kept  as it is\n@sheet s "S"\n@table t A1 csv\nItem,Cost,Twice\n"Rent, big",2,\nUtil,3,\n@end\n@fill t[Twice] =[@Cost]*2\n'


def test_edits_touch_nothing_else_and_are_undone():
    session = edits.Session(TEXT)
    session.edit(edits.set_cell(session.source, session.book, "s", 2, 1, 'a "b", c'))
    assert session.source == TEXT.replace('"Rent, big"', '"a ""b"", c"')
    session.edit(edits.append_row(session.source, session.book, "t", ["00123", 4.0, None]))
    assert "Util,3,\n00123,4,\n@end" in session.source
    session.edit(edits.rename_label(session.source, session.book, "s", "New"))
    after = session.source
    assert [session.undo() for _ in range(4)] == [True, True, True, False] and session.source == TEXT
    assert [session.redo() for _ in range(4)] == [True, True, True, False] and session.source == after


@pytest.mark.parametrize(("row", "col", "kind"), [(1, 1, "header"), (2, 3, "virtual"), (9, 9, "absent")])
def test_refusals(row, col, kind):
    with pytest.raises(edits.EditError) as e:
        edits.set_cell(TEXT, loads(TEXT), "s", row, col, 1.0)
    assert e.value.kind == kind


def test_diff_is_about_meaning():
    assert edits.semantic_diff(loads(TEXT), loads(TEXT.replace("[@Cost]*2", " ([@Cost]) * 2"))) == []
    changed = edits.semantic_diff(loads(TEXT), loads(TEXT.replace("Util,3", "Util,3.5").replace("*2", "*3")))
    assert [(w, c) for w, c, _ in changed] == [("cell", "changed"), ("fill", "changed")]


def test_command_line(tmp_path, capsys):
    path = tmp_path / "a.txt"
    path.write_text(TEXT)
    assert main(["check", str(path)]) == 0
    assert main(["calc", str(path), "s!C2:C3"]) == 0
    assert json.loads(capsys.readouterr().out.split("\n")[-2]) == [{"kind": "number", "value": 4.0}, {"kind": "number", "value": 6.0}]
    assert main(["set", str(path), "s!B2", "5"]) == 0 and '"Rent, big",5,' in path.read_text()
    assert main(["set", str(path), "s!C2", "5"]) == 1
    assert main(["append", str(path), "t", "x", "1", ""]) == 0
    (tmp_path / "b.txt").write_text(TEXT)
    assert main(["diff", str(path), str(tmp_path / "b.txt")]) == 1
    assert main(["check", str(tmp_path / "none.txt")]) == 2


def test_csv_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,'12,2026-02-28\n00123,\"x, \"\"y\"\"\",2026-02-30\n,,\n")
    kinds = {"a": "number", "c": "date"}
    rows = csvfile.read(spark, str(tmp_path / "t.csv"), kinds).collect()
    assert [(r.a, r.b, str(r.c)) for r in rows] == [(1.0, "12", "2026-02-28"), (None, 'x, "y"', "None"), (None, None, "None")]
    assert csvfile.misread(spark, str(tmp_path / "t.csv"), kinds) == {"a": 1, "c": 1}
    df = spark.createDataFrame([(1000.0, "12", True), (None, 'q"', None), (0.5, "", False), (-0.0, "=1", True)], "n double, s string, b boolean")
    assert [r.line for r in csvfile.lines(df).collect()] == ["1e3,'12,true", ',"q""",', "0.5,',false", "-0,'=1,true"]


def test_command_line_keeps_line_ends_and_reports_bad_bytes(tmp_path, capsys):
    file = tmp_path / "a.ms"
    file.write_bytes(TEXT.replace("\n", "\r\n").encode())
    file.chmod(0o640)
    assert main(["set", str(file), "s!B3", "4"]) == 0
    assert file.read_bytes() == TEXT.replace("\n", "\r\n").replace("Util,3", "Util,4").encode()
    assert file.stat().st_mode & 0o777 == 0o640 and [f.name for f in tmp_path.iterdir()] == ["a.ms"]
    file.write_bytes(b'#!lattica 0.1\n@sheet s "S"\n# \xff\n')
    assert main(["check", str(file)]) == 1 and "MS1003" in capsys.readouterr().out
