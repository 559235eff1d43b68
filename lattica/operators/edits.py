"""Edits of workbook text that leave every other byte as it is.

Each edit gives the patches it makes (start, end, replacement, by character) and
an edit session keeps them, so that undo restores the text exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lattica.functions.values import infer, kind_of, quote, spell, spell_field
from lattica.sources.workbook import Workbook, loads


class EditError(ValueError):
    """The edit is refused; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Patch:
    start: int
    end: int
    text: str


def apply(source: str, patches: list[Patch]) -> tuple[str, list[Patch]]:
    """(patched text, patches that undo it); patches may not overlap."""
    out, inverse, at, shift = [], [], 0, 0
    for p in sorted(patches, key=lambda p: p.start):
        if p.start < at or p.end > len(source):
            raise EditError("overlap", "patches overlap")
        out += [source[at : p.start], p.text]
        inverse.append(Patch(p.start + shift, p.start + shift + len(p.text), source[p.start : p.end]))
        shift += len(p.text) - (p.end - p.start)
        at = p.end
    return "".join(out) + source[at:], inverse


def _fields(source: str, line: int) -> list[list[tuple[int, int]]]:
    """Places of the fields of the block whose directive is on the line (from 1)."""
    at = 0
    for _ in range(line):
        at = source.index("\n", at) + 1
    out, record = [], []
    pattern = re.compile(r'"(?:[^"]|"")*"|[^",\r\n]*')
    while not re.compile(r"@end\r?(\n|$)").match(source, at) or record:
        m = pattern.match(source, at)
        record.append((m.start(), m.end()))
        at = m.end()
        if source[at] == ",":
            at += 1
            continue
        at += 2 if source[at] == "\r" else 1
        out.append(record)
        record = []
    return out


def set_cell(source: str, book: Workbook, sheet: str, row: int, col: int, value) -> list[Patch]:
    """Replace an authored field; cells that a fill makes, and cells outside blocks, are refused."""
    found = next((s for s in book.sheets if s.name == sheet), None)
    if found is None:
        raise EditError("unknown_sheet", f"no sheet {sheet}")
    for b in found.of("block"):
        r0, c0, r1, c1 = b.corners
        if r0 <= row <= r1 and c0 <= col <= c1:
            if b.table and row == r0:
                raise EditError("header", "a table's headers are no cells to set")
            from lattica.plans.sheets import Calculator

            if (sheet, row, col) in Calculator(book).virtual:
                raise EditError("virtual", "a fill makes this cell")
            start, end = _fields(source, b.line)[row - r0][col - c0]
            return [Patch(start, end, quote(spell_field(value), c0 == c1))]
    raise EditError("absent", "no field is authored there")


def append_row(source: str, book: Workbook, table: str, values: list) -> list[Patch]:
    """Add a data row before the table's ``@end``."""
    found = book.table(table)
    if found is None:
        raise EditError("unknown_table", f"no table {table}")
    block = found[1]
    if len(values) != len(block.headers):
        raise EditError("width", "a row has as many values as the table has headers")
    at = _fields(source, block.line)[-1][-1][1]
    at = source.index("\n", at) + 1
    return [Patch(at, at, ",".join(quote(spell_field(v), len(values) == 1) for v in values) + "\n")]


def rename_label(source: str, book: Workbook, sheet: str, label: str) -> list[Patch]:
    """Change a sheet's label; formulas name the id and are not touched."""
    import json

    m = re.search(rf'^@sheet {re.escape(sheet)} ("(?:[^"\\]|\\.)*")', source, re.MULTILINE)
    if not m:
        raise EditError("unknown_sheet", f"no sheet {sheet}")
    return [Patch(m.start(1), m.end(1), json.dumps(label, ensure_ascii=False))]


def _directives(source: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every directive, its body included."""
    out, at, start, inside, quoted = [], 0, 0, None, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", source):
        bare = line.rstrip("\r\n")
        if inside:
            if not quoted and bare == "@end":
                out.append((inside, start, at + len(line)))
                inside = None
            elif inside != "extension":
                quoted ^= bare.count('"') % 2 == 1
        elif bare.startswith("@"):
            kind, start = bare[1:].split(" ")[0], at
            if kind in ("block", "table", "extension"):
                inside, quoted = kind, False
            else:
                out.append((kind, at, at + len(line)))
        at += len(line)
    return out


def _insert(source: str, at: int, line: str) -> list[Patch]:
    """A line of its own at a place between lines."""
    end = "\r\n" if "\r\n" in source else "\n"
    before = end if at and source[at - 1] != "\n" else ""
    return [Patch(at, at, before + line + end)]


def _of_sheet(source: str, sheet: str) -> list[tuple[str, int, int]]:
    """The directives of a sheet, its own first."""
    found = _directives(source)
    first = next((i for i, (kind, a, b) in enumerate(found) if kind == "sheet" and source[a:b].split(" ")[1] == sheet), None)
    if first is None:
        raise EditError("unknown_sheet", f"no sheet {sheet}")
    last = next((i for i in range(first + 1, len(found)) if found[i][0] == "sheet"), len(found))
    return found[first:last]


def _geometry(source: str, book: Workbook, sheet: str, kind: str, first: int, last: int, size: float) -> list[Patch]:
    from lattica.plans.formula import column_letters

    if not 1 <= first <= last or not 0 < size < float("inf"):
        raise EditError("geometry", f"a {kind} is from 1 on and has a size above 0")
    own = _of_sheet(source, sheet)
    given = next(s for s in book.sheets if s.name == sheet).of(kind)
    edges = sorted({first, *(x for a, b, _ in given for x in (a, b + 1) if first <= x <= last)})
    if all(next((w for a, b, w in reversed(given) if a <= x <= b), None) == size for x in edges):
        return []
    name = column_letters if kind == "column" else str
    span = name(first) if first == last else f"{name(first)}:{name(last)}"
    return _insert(source, own[-1][2], f"@{kind} {span} {'width' if kind == 'column' else 'height'}={spell(float(size))}")


def set_width(source: str, book: Workbook, sheet: str, first: int, last: int, width: float) -> list[Patch]:
    """A width for columns first to last, as the sheet's last declaration; nothing where they have it already."""
    return _geometry(source, book, sheet, "column", first, last, width)


def set_height(source: str, book: Workbook, sheet: str, first: int, last: int, height: float) -> list[Patch]:
    """A height for rows first to last, as the sheet's last declaration; nothing where they have it already."""
    return _geometry(source, book, sheet, "row", first, last, height)


def set_name(source: str, book: Workbook, name: str, target: str) -> list[Patch]:
    """Let a name stand for another cell, range or table column."""
    from lattica.plans.formula import canonical, parse

    if name not in book.names:
        raise EditError("unknown_name", f"no name {name}")
    wanted = canonical(parse(target))
    if wanted == canonical(book.names[name]):
        return []
    for kind, a, b in _directives(source):
        m = re.match(r"@name (\S+) = ([^\r\n]*)", source[a:b]) if kind == "name" else None
        if m and m[1] == name:
            return [Patch(a + m.start(2), a + m.end(2), wanted)]
    raise EditError("unlocatable", f"{name} has no declaration")


def define_style(source: str, book: Workbook, style: str, properties: dict[str, object]) -> list[Patch]:
    """A style after the last one, before the sheets; nothing if it is there with equal properties."""
    from lattica.sources.workbook import _show

    if style in book.styles:
        if book.styles[style] == properties:
            return []
        raise EditError("conflict", f"there is another style {style}")
    found = _directives(source)
    head = found[: next((i for i, f in enumerate(found) if f[0] == "sheet"), len(found))]
    styles = [f for f in head if f[0] == "style"] or head
    at = styles[-1][2] if styles else source.find("\n") + 1 or len(source)
    return _insert(source, at, " ".join([f"@style {style}", *(f"{k}={_show(v)}" for k, v in properties.items())]))


def apply_style(source: str, book: Workbook, sheet: str, target: str, styles: list[str]) -> list[Patch]:
    """Styles for a target, after the sheet's last application, so that they win over earlier ones."""
    from lattica.plans.formula import canonical, parse

    missing = [s for s in styles if s not in book.styles]
    if missing or not styles:
        raise EditError("unknown_style", f"no style {', '.join(missing)}")
    own = _of_sheet(source, sheet)
    at = ([f for f in own if f[0] == "apply"] or own)[-1][2]
    return _insert(source, at, f"@apply {canonical(parse(target))} {' '.join(styles)}")


def fingerprint(source: str | bytes) -> tuple[int, int]:
    """(bytes, FNV-1a of 64 bits) of a text: tells most changes at once; the text itself decides."""
    data = source.encode() if isinstance(source, str) else source
    h = 0xCBF29CE484222325  # fixed values: the offset basis and the prime of FNV-1a
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return len(data), h


@dataclass
class Session:
    """A text with undo and redo; every edit is checked by parsing what it makes."""

    source: str
    undone: list[list[Patch]] = field(default_factory=list)
    done: list[list[Patch]] = field(default_factory=list)

    @property
    def book(self) -> Workbook:
        return loads(self.source)

    def edit(self, patches: list[Patch], expected: str | None = None) -> None:
        """Apply patches; with ``expected``, only if that is the text they were made for."""
        if expected is not None and (fingerprint(expected) != fingerprint(self.source) or expected != self.source):
            raise EditError("stale", "the text is not the one that the edit was made for")
        text, inverse = apply(self.source, patches)
        if any(d.severity == "error" for d in loads(text).diagnostics):
            raise EditError("invalid_result", "the edit would make the workbook invalid")
        self.source, self.undone = text, []
        self.done.append(inverse)

    def undo(self) -> bool:
        if not self.done:
            return False
        self.source, again = apply(self.source, self.done.pop())
        self.undone.append(again)
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        self.source, inverse = apply(self.source, self.undone.pop())
        self.done.append(inverse)
        return True


def semantic_diff(before: Workbook, after: Workbook) -> list[tuple[str, str, str]]:
    """(what, change, detail) of what means something else; formulas are compared by canonical text, layout is not."""
    from lattica.plans.formula import canonical, parse
    from lattica.sources.workbook import authored

    def meaning(v) -> tuple:
        return ("formula", canonical(parse(v.text))) if kind_of(v) == "formula" else (kind_of(v), repr(v))

    out = []

    def compare(what: str, a: dict, b: dict) -> None:
        for k in sorted({*a, *b}, key=str):
            if k not in b:
                out.append((what, "removed", str(k)))
            elif k not in a:
                out.append((what, "added", str(k)))
            elif a[k] != b[k]:
                out.append((what, "changed", str(k)))

    cells = [{k: meaning(v) for k, v in authored(w).items()} for w in (before, after)]
    compare("sheet", *({s.name: s.label for s in w.sheets} for w in (before, after)))
    if [s.name for s in before.sheets if s.name in {x.name for x in after.sheets}] != [s.name for s in after.sheets if s.name in {x.name for x in before.sheets}]:
        out.append(("sheet", "reordered", ""))
    compare("cell", *cells)
    compare("name", *({n: canonical(t) for n, t in w.names.items()} for w in (before, after)))
    compare("style", before.styles, after.styles)
    compare("setting", before.settings, after.settings)
    compare("fill", *({(s.name, canonical(t)): canonical(f) for s in w.sheets for t, f, _ in s.of("fill")} for w in (before, after)))
    return out


def read_value(text: str):
    """A value as typed in: the source rules."""
    return infer(text)
