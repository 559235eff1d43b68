"""Plain-text workbooks: parsing, diagnostics, canonical writing, and the tables they hold as DataFrames.

A workbook is small beside the tables it is used with, so one file is parsed as
a whole; ``read`` parses many files at once, a file a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.values import DateTime, Err, Formula, infer, infer_strict, kind_of, quote, spell, spell_field
from lattica.plans.formula import FormulaError, Ref, TableRef, column_letters, parse, parse_area

#: The first line of a file: any format name, version 0.1; new workbooks get the default.
HEADER, DEFAULT_HEADER = re.compile(r"#![a-z]+ 0\.1"), "#!lattica 0.1"
_ID = r"[a-z][a-z0-9_]*"
_ADDRESS = re.compile(r"[a-z]+[0-9]+|r[0-9]*c[0-9]*", re.IGNORECASE)
#: Capabilities that are there.
AVAILABLE = frozenset({"assertions@1"})
_STYLE = {"bold", "italic", "wrap", "text-color", "fill", "font-size", "align", "valign", "number", "decimals", "currency"}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    line: int
    message: str
    severity: str = "error"


@dataclass
class Block:
    """Fields of a block or, with a name, of a table, at (row, col)."""

    row: int
    col: int
    fields: list[list[str]]
    line: int
    table: str | None = None

    @property
    def headers(self) -> list[str]:
        return [infer(f) for f in self.fields[0]] if self.table else []

    @property
    def corners(self) -> tuple[int, int, int, int]:
        return self.row, self.col, self.row + len(self.fields) - 1, self.col + len(self.fields[0]) - 1


@dataclass
class Sheet:
    name: str
    label: str
    items: list[tuple[str, object]] = field(default_factory=list)  # block, fill, apply, column, row, extension in source order

    def of(self, kind: str) -> list:
        return [x for k, x in self.items if k == kind]


@dataclass
class Workbook:
    header: str = DEFAULT_HEADER
    settings: dict[str, str] = field(default_factory=lambda: {"locale": "en-US", "timezone": "UTC", "formula-profile": "portable-a1@1"})
    styles: dict[str, dict[str, object]] = field(default_factory=dict)
    names: dict[str, object] = field(default_factory=dict)
    extensions: list[tuple[str, str]] = field(default_factory=list)
    sheets: list[Sheet] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    nodes: list[tuple[str, object]] = field(default_factory=list)  # all that the text holds after its first line, in order

    def table(self, name: str) -> tuple[Sheet, Block] | None:
        for sheet in self.sheets:
            for block in sheet.of("block"):
                if block.table == name:
                    return sheet, block
        return None


class _Stop(Exception):
    """A line that breaks a rule."""

    def __init__(self, code: str, message: str):
        self.code, self.message = code, message


def split_csv(text: str) -> list[list[str]]:
    """Records of RFC 4180 text that ends with a line end; CRLF in a quoted field reads as LF."""
    out, record, at = [], [], 0
    while at < len(text):
        if text[at] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=,|\r?\n)').match(text, at)
            if not m:
                raise _Stop("MS1102", "malformed CSV")
            record.append(m[1].replace('""', '"').replace("\r\n", "\n"))
        else:
            m = re.compile(r'([^",\r\n]*)(?=,|\r?\n)').match(text, at)
            if not m:
                raise _Stop("MS1102", "malformed CSV")
            record.append(m[1])
        at = m.end()
        if text[at] == ",":
            at += 1
            if at == len(text):
                raise _Stop("MS1102", "malformed CSV")
            continue
        at += 2 if text[at] == "\r" else 1
        out.append(record)
        record = []
    return out


def _properties(text: str) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 0
    pattern = re.compile(r'([a-z][a-z0-9-]*)=("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[a-z][a-z0-9_]*)(?: +|$)')
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m[1] in out:
            raise _Stop("MS1201", "malformed or repeated property")
        raw = m[2]
        out[m[1]] = json.loads(raw) if raw[0] in '"-0123456789' or raw in ("true", "false") else raw
        at = m.end()
    return out


def _overlap(a: tuple, b: tuple) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def area(ref: Ref) -> tuple[int, int, int, int]:
    """(row, col, last row, last col), in order."""
    end = ref.end or ref.start
    rows, cols = sorted((ref.start.row, end.row)), sorted((ref.start.col, end.col))
    return rows[0], cols[0], rows[1], cols[1]


class _Parser:
    def __init__(self, text: str):
        self.book, self.at, self.sheet = Workbook(), 0, None
        self.ids: set[str] = set()
        for n, line in enumerate(re.split(r"\r\n|\n", text), 1):
            for _ in range(line.count("\r")):
                self.note("MS1004", n, "a bare carriage return is no line end")
        if text.startswith("\ufeff"):
            self.note("MS1002", 1, "a byte-order mark is not permitted")
        self.lines = re.sub(r"\r(?!\n)", "\n", text).split("\n")

    def run(self) -> Workbook:
        if HEADER.fullmatch(self.lines[0].rstrip("\r")):
            self.book.header, self.at = self.lines[0].rstrip("\r"), 1
        else:
            self.note("MS1001", 1, "unsupported version header")
            self.at = int(self.lines[0].startswith("#!"))
        while self.at < len(self.lines):
            line, number = self.lines[self.at].rstrip("\r"), self.at + 1
            self.at += 1
            if line.startswith("#!"):
                self.note("MS1001", number, "the version header is repeated")
                continue
            if not line.strip() or line.startswith("#"):
                if self.at < len(self.lines) or line:
                    self.book.nodes.append(("text", line))
                continue
            word, _, rest = line.partition(" ")
            handler = getattr(self, "d_" + word[1:], None) if word.startswith("@") else None
            try:
                if handler is None:
                    raise _Stop("MS1101", "expected a directive, a comment or a blank line")
                self.book.nodes.append((word[1:], handler(rest.strip(), number)))
            except (_Stop, FormulaError, ValueError) as e:
                self.note(getattr(e, "code", "MS1101"), number, getattr(e, "message", str(e)))
        if not self.book.sheets:
            self.note("MS1101", len(self.lines), "a workbook needs a sheet")
        self.finish()
        return self.book

    def note(self, code: str, line: int, message: str, severity: str = "error") -> None:
        self.book.diagnostics.append(Diagnostic(code, line, message, severity))

    def within(self) -> Sheet:
        if self.sheet is None:
            raise _Stop("MS1101", "this belongs in a sheet")
        return self.sheet

    def body(self) -> str:
        """Text up to ``@end`` on its own line outside quotes."""
        lines, quoted = [], False
        while self.at < len(self.lines):
            line = self.lines[self.at]
            self.at += 1
            if not quoted and line.rstrip("\r") == "@end":
                return "".join(x + "\n" for x in lines)
            quoted ^= line.count('"') % 2 == 1
            lines.append(line)
        raise _Stop("MS1102", "the CSV has no @end")

    @staticmethod
    def known_id(text: str) -> str:
        if not re.fullmatch(_ID, text) or text in ("true", "false"):
            raise _Stop("MS1201", f"no identifier: {text}")
        return text

    @staticmethod
    def placed(text: str):
        try:
            return parse_area(text)
        except FormulaError as e:
            raise _Stop("MS1202", str(e)) from e

    def d_book(self, rest: str, line: int) -> dict[str, object]:
        if self.sheet is not None:
            raise _Stop("MS1101", "@book must precede the sheets")
        found = _properties(rest)
        if set(found) - set(self.book.settings):
            raise _Stop("MS1101", "unknown property")
        self.book.settings |= found
        return found

    def d_sheet(self, rest: str, line: int) -> Sheet:
        name, _, label = rest.partition(" ")
        self.known_id(name)
        if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', label):
            raise _Stop("MS1101", "malformed sheet")
        if any(s.name == name for s in self.book.sheets):
            raise _Stop("MS1301", "repeated sheet")
        self.sheet = Sheet(name, json.loads(label))
        self.book.sheets.append(self.sheet)
        return self.sheet

    def _block(self, anchor: str, line: int, table: str | None) -> Block:
        sheet, text = self.within(), self.body()
        start, records = self.placed(anchor), split_csv(text)
        if not records or len({len(r) for r in records}) > 1:
            raise _Stop("MS1204", "a block is a rectangle of one field at least")
        block = Block(start.start.row, start.start.col, records, line, table)
        if table:
            headers = block.headers
            if table in self.ids:
                raise _Stop("MS1301", "repeated table")
            if not all(isinstance(h, str) and h for h in headers) or len({*headers}) < len(headers):
                raise _Stop("MS2201", "a table needs different text headers")
            self.ids.add(table)
        if any(_overlap(block.corners, other.corners) for other in sheet.of("block")):
            raise _Stop("MS1302", "footprints overlap")
        for record in records:
            for f in record:
                value = infer(f)
                if isinstance(value, Formula):
                    parse(value.text)
        sheet.items.append(("block", block))
        return block

    def _encoded(self, rest: list[str]) -> None:
        if rest != ["csv"]:
            raise _Stop("MS1101", "csv is the only encoding")

    def d_block(self, rest: str, line: int) -> Block:
        words = rest.split()
        try:
            self._encoded(words[1:])
        except _Stop:
            self.body()
            raise
        return self._block(words[0], line, None)

    def d_table(self, rest: str, line: int) -> Block:
        words = rest.split()
        try:
            if _ADDRESS.fullmatch(self.known_id(words[0] if words else "")):
                raise _Stop("MS1201", "a table's id may not look like a cell")
            self._encoded(words[2:])
        except _Stop:
            self.body()
            raise
        return self._block(words[1], line, words[0])

    def d_style(self, rest: str, line: int) -> str:
        name, _, properties = rest.partition(" ")
        self.known_id(name)
        if name in self.book.styles:
            raise _Stop("MS1301", "repeated style")
        found = _properties(properties.strip())
        if set(found) - _STYLE:
            raise _Stop("MS1101", "unknown property")
        decimals, size = found.get("decimals", 0), found.get("font-size", 1)
        if found.get("number") == "currency" and "currency" not in found:
            raise _Stop("MS2201", "a currency style names its currency")
        if not isinstance(decimals, int) or not 0 <= decimals <= 15 or not isinstance(size, int | float) or size <= 0:
            raise _Stop("MS2201", "a style's number is out of its range")
        self.book.styles[name] = found
        return name

    def d_name(self, rest: str, line: int) -> str:
        name, _, text = rest.partition(" = ")
        if _ADDRESS.fullmatch(self.known_id(name)) or name in self.book.names:
            raise _Stop("MS1301" if name in self.book.names else "MS1201", "a name is repeated or looks like a cell")
        target = parse(text)
        if not (isinstance(target, Ref) and target.sheet) and not (isinstance(target, TableRef) and target.table and not target.current_row):
            raise _Stop("MS1202", "a name stands for a cell, a range or a table column")
        self.book.names[name] = target
        return name

    def _extension(self, kind: str, rest: str, line: int) -> str:
        if not re.fullmatch(r"[a-z][a-z0-9._-]*@[1-9][0-9]*", rest):
            raise _Stop("MS1201", "malformed extension id")
        if rest not in AVAILABLE:
            if kind == "require":
                self.note("MS3101", line, "a required extension is not available")
            else:
                self.note("MS3102", line, "an optional extension is not available", "warning")
        self.book.extensions.append((kind, rest))
        return rest

    def d_use(self, rest: str, line: int) -> str:
        return self._extension("use", rest, line)

    def d_require(self, rest: str, line: int) -> str:
        return self._extension("require", rest, line)

    def d_extension(self, rest: str, line: int) -> tuple[str, str, int]:
        payload = []
        while self.at < len(self.lines) and self.lines[self.at].rstrip("\r") != "@end":
            payload.append(self.lines[self.at])
            self.at += 1
        if self.at == len(self.lines):
            raise _Stop("MS1101", "the extension has no @end")
        self.at += 1
        item = (rest, "\n".join(payload), line)
        if rest.split(" ")[0] not in {e for _, e in self.book.extensions}:
            self.note("MS3103", line, "extension is not declared", "warning")
        if self.sheet:
            self.sheet.items.append(("extension", item))
        else:
            self.book.extensions.append(("extension", item))
        return item

    def d_fill(self, rest: str, line: int) -> tuple:
        target, _, formula = rest.partition(" =")
        item = (parse(target), parse(formula), line)
        self.within().items.append(("fill", item))
        return item

    def d_apply(self, rest: str, line: int) -> tuple:
        m = re.fullmatch(r"(\S*\[[^\]]+\]|\S+)((?: +\S+)+)", rest)
        if not m:
            raise _Stop("MS1101", "malformed apply")
        item = (parse(m[1]), [self.known_id(x) for x in m[2].split()], line)
        self.within().items.append(("apply", item))
        return item

    def _geometry(self, kind: str, key: str, rest: str) -> tuple[int, int, float]:
        m = re.fullmatch(rf"(\S+) {key}=(\S+)", rest)
        if not m:
            raise _Stop("MS1101", f"malformed {kind}")
        span = re.fullmatch(r"([A-Za-z]+)(?::([A-Za-z]+))?" if kind == "column" else r"([1-9][0-9]*)(?::([1-9][0-9]*))?", m[1])
        if not span:
            raise _Stop("MS1202", f"no {kind}: {m[1]}")
        if not re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", m[2]) or not 0 < float(m[2]) < float("inf"):
            raise _Stop("MS2201", f"a {kind} has a {key} above 0")
        at = [parse_area(x + "1").start.col if kind == "column" else int(x) for x in (span[1], span[2] or span[1])]
        item = (min(at), max(at), float(m[2]))
        self.within().items.append((kind, item))
        return item

    def d_column(self, rest: str, line: int) -> tuple[int, int, float]:
        return self._geometry("column", "width", rest)

    def d_row(self, rest: str, line: int) -> tuple[int, int, float]:
        return self._geometry("row", "height", rest)

    def finish(self) -> None:
        book, sheets = self.book, {s.name for s in self.book.sheets}
        for name, target in book.names.items():
            if name in self.ids:
                self.note("MS1301", 1, f"{name} is both a name and a table")
            known = target.sheet in sheets if isinstance(target, Ref) else False
            if isinstance(target, TableRef):
                found = book.table(target.table)
                known = found is not None and (target.selector in ("#Data", "#Headers") or target.selector in found[1].headers)
            if not known:
                self.note("MS2101", 1, f"{name} has no target")
        for sheet in book.sheets:
            for _, styles, line in sheet.of("apply"):
                for s in styles:
                    if s not in book.styles:
                        self.note("MS2102", line, f"no style {s}")
            for target, _, line in sheet.of("fill"):
                if isinstance(target, TableRef) and not any(b.table == target.table and target.selector in b.headers for b in sheet.of("block")):
                    self.note("MS2102", line, "a fill's column is not there")
                elif fill_area(sheet, target) is None:
                    self.note("MS2201", line, "a fill lies in one earlier block, on blank cells")


def fill_area(sheet: Sheet, target) -> tuple[int, int, int, int] | None:
    """The rectangle that a fill covers; None if the rules forbid it."""
    blocks = sheet.of("block")
    if isinstance(target, TableRef):
        found = [b for b in blocks if b.table == target.table and target.selector in b.headers and len(b.fields) > 1]
        if not found:
            return None
        b = found[0]
        col = b.col + b.headers.index(target.selector)
        where = (b.row + 1, col, b.corners[2], col)
    elif isinstance(target, Ref) and target.sheet is None:
        where = area(target)
    else:
        return None
    owners = [b for b in blocks if _overlap(b.corners, where)]
    if len(owners) != 1:
        return None
    b = owners[0]
    if not (b.corners[0] <= where[0] and b.corners[1] <= where[1] and where[2] <= b.corners[2] and where[3] <= b.corners[3]):
        return None
    blank = all(b.fields[r - b.row][c - b.col] == "" for r in range(where[0], where[2] + 1) for c in range(where[1], where[3] + 1))
    return where if blank else None


def loads(text: str | bytes) -> Workbook:
    """Parse a workbook; what breaks a rule is in its diagnostics."""
    if isinstance(text, bytes):
        try:
            return _Parser(text.decode()).run()
        except UnicodeDecodeError as e:
            book = _Parser(text.decode(errors="replace")).run()
            line = text.count(b"\n", 0, e.start) + 1
            book.diagnostics.insert(0, Diagnostic("MS1003", line, "the text is not valid UTF-8"))
            return book
    return _Parser(text).run()


def _target(node) -> str:
    from lattica.plans.formula import canonical

    return canonical(node)


def _show(v) -> str:
    return v if isinstance(v, str) and re.fullmatch(_ID, v) else json.dumps(v, ensure_ascii=False)


def _canonical(book: Workbook, kind: str, x) -> list[str]:
    """Lines of one thing that a workbook holds."""
    match kind:
        case "text":
            return [x]
        case "book":
            return ["@book " + " ".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in x.items())]
        case "use" | "require":
            return [f"@{kind} {x}"]
        case "style":
            return [" ".join([f"@style {x}", *(f"{k}={_show(v)}" for k, v in book.styles[x].items())])]
        case "name":
            return [f"@name {x} = {_target(book.names[x])}"]
        case "sheet":
            return [f"@sheet {x.name} {json.dumps(x.label, ensure_ascii=False)}"]
        case "block" | "table":
            anchor = f"{column_letters(x.col)}{x.row}"
            head = f"@table {x.table} {anchor} csv" if x.table else f"@block {anchor} csv"
            return [head, *(",".join(quote(spell_field(infer(f)), len(r) == 1) for f in r) for r in x.fields), "@end"]
        case "fill":
            return [f"@fill {_target(x[0])} ={_target(x[1])}"]
        case "apply":
            return [f"@apply {_target(x[0])} {' '.join(x[1])}"]
        case "extension":
            return [f"@extension {x[0]}", *([x[1]] if x[1] else []), "@end"]
    first, last = (column_letters(x[0]), column_letters(x[1])) if kind == "column" else (str(x[0]), str(x[1]))
    return [f"@{kind} {first if first == last else f'{first}:{last}'} {'width' if kind == 'column' else 'height'}={spell(x[2])}"]


def dumps(book: Workbook) -> str:
    """Canonical text, each thing in its place, comments and blank lines as they are; refuses a workbook with errors.

    A workbook that was not parsed has its settings, extensions, styles and names first.
    """
    if any(d.severity == "error" for d in book.diagnostics):
        raise ValueError("a workbook with errors has no canonical text")
    nodes = book.nodes
    if not nodes:
        nodes = [("book", book.settings), *book.extensions, *(("style", n) for n in book.styles), *(("name", n) for n in book.names)]
        for sheet in book.sheets:
            nodes += [("text", ""), ("sheet", sheet), *sheet.items]
    return "\n".join([book.header, *(line for kind, x in nodes for line in _canonical(book, kind, x))]) + "\n"


CELLS = "path string, sheet string, row long, col long, kind string, num double, txt string, bool boolean, day date, err string"


def value_row(v) -> tuple:
    """(kind, num, txt, bool, day, err) of a value; datetimes are spelled in txt."""
    kind = kind_of(v)
    text = v if kind == "text" else v.text if isinstance(v, Formula) else spell(v) if isinstance(v, DateTime) else None
    return kind, v if kind == "number" else None, text, v if kind == "boolean" else None, v if kind == "date" else None, v.token if isinstance(v, Err) else None


def read(spark: SparkSession, path: str, calculated: bool = False) -> DataFrame:
    """Cells of all workbook files under a path, as authored or calculated; one task reads a file whole."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.plans.sheets import Calculator

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                book = loads(content)
                found = Calculator(book).all_values() if calculated else authored(book)
                rows = [(name, *key, *value_row(v)) for key, v in found.items()]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.date32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CELLS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInArrow(task, CELLS)


def _each(texts: DataFrame, give, schema: str) -> DataFrame:
    """key and the rows that give() makes of each workbook text (key, source)."""
    types = [pa.int64(), *(_ARROW[f.split()[1]] for f in schema.split(", "))]
    names = ["key", *(f.split()[0] for f in schema.split(", "))]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *row) for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in give(loads(source or ""))]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.select(F.col("key").cast("long").alias("key"), "source").mapInArrow(task, f"key long, {schema}")


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}


def cells(texts: DataFrame, calculated: bool = False) -> DataFrame:
    """key and cells, as authored or calculated, of workbook texts (key, source), a workbook a row."""

    def give(book: Workbook) -> Iterator[tuple]:
        from lattica.plans.sheets import Calculator

        found = Calculator(book).all_values() if calculated else authored(book)
        return ((*key, *value_row(v)) for key, v in found.items())

    return _each(texts, give, CELLS.removeprefix("path string, "))


def diagnostics(texts: DataFrame) -> DataFrame:
    """key, code, line, message, severity of what breaks rules in workbook texts (key, source)."""
    return _each(texts, lambda book: [(d.code, d.line, d.message, d.severity) for d in book.diagnostics], "code string, line long, message string, severity string")


def canonical_text(source: Column) -> Column:
    """Canonical text of a column of workbook texts; null where a text has errors."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        books = [loads(t or "") for t in texts.to_pylist()]
        return pa.array([None if any(d.severity == "error" for d in b.diagnostics) else dumps(b) for b in books], pa.string())

    return run(source)


def edited(source: Column, verb: str, *args) -> Column:
    """A column of workbook texts after an edit by its name in lattica.operators.edits (set_cell, append_row, set_width ...); null where it is refused."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        from lattica.operators import edits

        make = getattr(edits, verb)
        out = []
        for text in texts.to_pylist():
            session = edits.Session(text or "")
            try:
                session.edit(make(session.source, session.book, *args))
                out.append(session.source)
            except edits.EditError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(source)


def calculated_text(source: Column, target: str) -> Column:
    """The values of a range of workbook texts, as ``calc`` prints them; null where a text has errors."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        from lattica.plans.sheets import Calculator

        books = [loads(t or "") for t in texts.to_pylist()]
        return pa.array([None if any(d.severity == "error" for d in b.diagnostics) else Calculator(b).text(parse_area(target)) for b in books], pa.string())

    return run(source)


def graph_stats(texts: DataFrame) -> DataFrame:
    """key and the size of the graph of workbook texts (key, source) and of the work to calculate it."""

    def give(book: Workbook) -> Iterator[tuple]:
        from lattica.plans.sheets import Calculator

        calculator = Calculator(book)
        calculator.all_values()
        yield tuple(calculator.stats().values())

    return _each(texts, give, "nodes long, edges long, cyclic_cells long, cyclic_components long, dirty long, evaluated long")


def strict_kinds(fields: Column) -> Column:
    """Kind of each source field; ``invalid`` for what looks like a date or datetime and is none, null for null."""

    @F.arrow_udf("string")
    def run(fields: pa.Array) -> pa.Array:
        def kind(f: str | None) -> str | None:
            try:
                return None if f is None else kind_of(infer_strict(f))
            except ValueError:
                return "invalid"

        return pa.array([kind(f) for f in fields.to_pylist()], pa.string())

    return run(fields)


def authored(book: Workbook) -> dict[tuple[str, int, int], object]:
    """(sheet, row, col) -> value of every field, blanks included."""
    out = {}
    for sheet in book.sheets:
        for b in sheet.of("block"):
            for i, record in enumerate(b.fields):
                for j, f in enumerate(record):
                    out[sheet.name, b.row + i, b.col + j] = infer(f)
    return out
