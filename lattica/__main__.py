"""python -m lattica check|inspect|get|calc|text|stats|fmt|set|append|diff FILE ...; 0: fine, 1: refused or different, 2: unusable."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from lattica.functions.values import Err, infer, kind_of, spell
from lattica.operators import edits
from lattica.plans import registry
from lattica.plans.formula import Ref, TableRef, column_letters, parse_area
from lattica.plans.sheets import Calculator
from lattica.sources.workbook import Workbook, area, authored, dumps, loads


def _json(value) -> dict:
    kind = kind_of(value)
    if kind == "blank":
        return {"kind": kind}
    return {"kind": kind, "value": value.token if isinstance(value, Err) else value if kind in ("number", "boolean", "text") else value.text if kind == "formula" else spell(value)}


def _range(book: Workbook, target: str) -> Ref:
    """The range that a target means: sheet!range, else a name, else a table with its headers."""
    found = None
    if "!" in target:
        found = parse_area(target)
    elif target in book.names:
        found = book.names[target]
        if isinstance(found, TableRef):
            _, _, cells = Calculator(book).resolve(found)
            found = parse_area(f"{cells[0][0]}!{_letter(cells[0])}:{_letter(cells[-1])}")
    elif book.table(target):
        sheet, block = book.table(target)
        r0, c0, r1, c1 = block.corners
        found = parse_area(f"{sheet.name}!{column_letters(c0)}{r0}:{column_letters(c1)}{r1}")
    if not isinstance(found, Ref) or found.sheet not in {s.name for s in book.sheets}:
        raise edits.EditError("unknown_target", f"no sheet, name or table: {target}")
    return found


def _letter(key: tuple[str, int, int]) -> str:
    return f"{column_letters(key[2])}{key[1]}"


def _cells(book: Workbook, target: str) -> list[tuple[str, int, int]]:
    ref = _range(book, target)
    r0, c0, r1, c1 = area(ref)
    return [(ref.sheet, r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]


def _replace(path: str, text: str) -> None:
    """Write the file whole or not at all: its bytes go to a new file beside it, which then takes its place."""
    target = Path(os.path.realpath(path))
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(text.encode())
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, target.stat().st_mode & 0o7777)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lattica")
    parser.add_argument("verb", choices=["check", "inspect", "get", "calc", "text", "stats", "fmt", "set", "append", "diff"])
    parser.add_argument("file")
    parser.add_argument("rest", nargs="*")
    args = parser.parse_args(argv)
    try:
        data = Path(args.file).read_bytes()
        book, source = loads(data), data.decode(errors="replace")
        errors = [d for d in book.diagnostics if d.severity == "error"]
        if args.verb == "check":
            found = [*book.diagnostics, *registry.validate(book)]
            failed = any(d.severity == "error" for d in found)
            calculation, rendering = registry.completeness(book)
            print(json.dumps({"valid": not failed, "calculation_complete": calculation, "rendering_complete": rendering, "diagnostics": [vars(d) for d in sorted(found, key=lambda d: (d.line, d.code))]}))
            return int(failed)
        if errors:
            print(f"{errors[0].code} line {errors[0].line}: {errors[0].message}", file=sys.stderr)
            return 1
        match args.verb:
            case "inspect":
                print(json.dumps({"sheets": [{"id": s.name, "label": s.label, "blocks": len(s.of("block")), "tables": [b.table for b in s.of("block") if b.table], "fills": len(s.of("fill"))} for s in book.sheets], "names": list(book.names), "styles": list(book.styles)}))
            case "get":
                found = authored(book)
                print(json.dumps([_json(found.get(k)) for k in _cells(book, args.rest[0])]))
            case "calc":
                keys = _cells(book, args.rest[0])
                values = Calculator(book).calculate(keys)
                print(json.dumps([_json(values[k]) for k in keys]))
            case "text":
                print(Calculator(book).text(_range(book, args.rest[0])), end="")
            case "stats":
                calculator = Calculator(book)
                calculator.all_values()
                print(json.dumps(calculator.stats()))
            case "fmt":
                print(dumps(book), end="")
            case "set":
                (key,) = _cells(book, args.rest[0])
                session = edits.Session(source)
                session.edit(edits.set_cell(source, book, *key, infer(args.rest[1])))
                _replace(args.file, session.source)
            case "append":
                session = edits.Session(source)
                session.edit(edits.append_row(source, book, args.rest[0], [infer(v) for v in args.rest[1:]]))
                _replace(args.file, session.source)
            case "diff":
                changes = edits.semantic_diff(book, loads(Path(args.rest[0]).read_bytes()))
                print(json.dumps(changes))
                return int(bool(changes))
    except edits.EditError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return 1
    except (OSError, UnicodeDecodeError, IndexError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
