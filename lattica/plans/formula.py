"""The formula language: text to syntax tree and back to canonical text."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from lattica.functions.values import spell_number

MAX_DEPTH = 256


class FormulaError(ValueError):
    """The text is no formula (MS2202)."""

    code = "MS2202"


@dataclass(frozen=True)
class Literal:
    value: object  # float, str, bool or an error token wrapped in Error


@dataclass(frozen=True)
class Error:
    token: str


@dataclass(frozen=True)
class CellRef:
    """One corner: column and row from 1, and which of them are fixed by ``$``."""

    col: int
    row: int
    fixed_col: bool = False
    fixed_row: bool = False


@dataclass(frozen=True)
class Ref:
    """A cell (``end`` is None) or a range, on a sheet or the formula's own."""

    sheet: str | None
    start: CellRef
    end: CellRef | None = None


@dataclass(frozen=True)
class NameRef:
    name: str


@dataclass(frozen=True)
class TableRef:
    """``t[Header]``, ``t[#Headers]``, ``t[#Data]``, ``t[@Header]`` or ``[@Header]`` (table None)."""

    table: str | None
    selector: str
    current_row: bool = False


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


_CELL = r"\$?[A-Za-z]+\$?[1-9][0-9]*"
_TOKEN = re.compile(
    rf"""
    (?P<space>[ \t\r\n]+)
  | (?P<number>(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.]))
  | (?P<text>"(?:[^"\r\n]|"")*")
  | (?P<error>\#(?:DIV/0!|N/A|NAME\?|NUM!|REF!|VALUE!|CIRC!))
  | (?P<call>[A-Za-z][A-Za-z0-9_]*)(?=[ \t\r\n]*\()
  | (?P<area>(?:(?P<sheet>[a-z][a-z0-9_]*)!)?{_CELL}(?::{_CELL})?)(?![A-Za-z0-9_\[!(])
  | (?P<table>[a-z][a-z0-9_]*)?\[(?P<selector>(?:[^\[\]]|\]\])+)\]
  | (?P<word>[A-Za-z][A-Za-z0-9_]*)
  | (?P<op><>|<=|>=|[-+*/^&=<>(),])
    """,
    re.VERBOSE,
)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def parse_cell(text: str) -> CellRef:
    m = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)([1-9][0-9]*)", text)
    if not m:
        raise FormulaError(f"no cell: {text}")
    return CellRef(column_number(m[2]), int(m[4]), bool(m[1]), bool(m[3]))


def parse_area(text: str) -> Ref:
    """``[sheet!]A1[:B2]``."""
    sheet, _, area = text.rpartition("!")
    first, colon, last = area.partition(":")
    return Ref(sheet or None, parse_cell(first), parse_cell(last) if colon else None)


def _lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m["space"]:
            continue
        if m["number"]:
            value = float(m["number"])
            if value == float("inf"):
                raise FormulaError("a number must be finite")
            out.append(("value", Literal(value)))
        elif m["text"]:
            out.append(("value", Literal(m["text"][1:-1].replace('""', '"'))))
        elif m["error"]:
            out.append(("value", Literal(Error(m["error"]))))
        elif m["call"]:
            out.append(("call", m["call"].upper()))
        elif m["area"]:
            out.append(("value", parse_area(m["area"])))
        elif m["selector"]:
            selector = m["selector"].replace("]]", "]")
            if not m["table"] and not selector.startswith("@"):
                raise FormulaError("a column needs its table")
            out.append(("value", TableRef(m["table"], selector.removeprefix("@"), selector.startswith("@"))))
        elif m["word"]:
            word = m["word"]
            if word.upper() in ("TRUE", "FALSE"):
                out.append(("value", Literal(word.upper() == "TRUE")))
            elif re.fullmatch(r"[a-z][a-z0-9_]*", word):
                out.append(("value", NameRef(word)))
            else:
                raise FormulaError(f"unknown word {word}")
        else:
            out.append(("op", m["op"]))
    return out


_COMPARE = ("=", "<>", "<", "<=", ">", ">=")
_LEVELS = (("&",), ("+", "-"), ("*", "/"))


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _lex(text), 0, 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FormulaError(f"{op} expected")

    def comparison(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FormulaError("nested too deeply")
        left = self.binary(0)
        kind, op = self.peek()
        if kind == "op" and op in _COMPARE:
            self.at += 1
            left = Binary(op, left, self.binary(0))
            kind, op = self.peek()
            if kind == "op" and op in _COMPARE:
                raise FormulaError("comparisons do not chain")
        self.depth -= 1
        return left

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[level]:
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.binary(level + 1))
        return left

    def unary(self):
        for op in "+-":
            if self.take(op):
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    raise FormulaError("nested too deeply")
                out = Unary(op, self.unary())
                self.depth -= 1
                return out
        base = self.primary()
        return Binary("^", base, self.unary()) if self.take("^") else base

    def primary(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "value":
            return value
        if kind == "call":
            self.need("(")
            args = []
            if not self.take(")"):
                args.append(self.comparison())
                while self.take(","):
                    args.append(self.comparison())
                self.need(")")
            return Call(value, tuple(args))
        if (kind, value) == ("op", "("):
            inner = self.comparison()
            self.need(")")
            return inner
        raise FormulaError("an operand is missing")


def parse(text: str):
    """Syntax tree of a formula, with or without its leading ``=``."""
    parser, frames = _Parser(text.removeprefix("=")), sys.getrecursionlimit()
    sys.setrecursionlimit(max(frames, 12 * MAX_DEPTH))
    try:
        tree = parser.comparison()
    finally:
        sys.setrecursionlimit(frames)
    if parser.peek()[0] != "end":
        raise FormulaError(f"unexpected {parser.peek()[1]!r}")
    return tree


def _strength(node) -> int:
    if isinstance(node, Unary):
        return 5
    if isinstance(node, Binary):
        return 1 if node.op in _COMPARE else {"&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 6}[node.op]
    return 7


def _cell(c: CellRef) -> str:
    return f"{'$' * c.fixed_col}{column_letters(c.col)}{'$' * c.fixed_row}{c.row}"


def canonical(node) -> str:
    """The tree as text, with upper-case functions, shortest numbers and no needless parentheses."""

    def wrap(child, least: int) -> str:
        text = canonical(child)
        return f"({text})" if _strength(child) < least else text

    match node:
        case Literal(value=Error(token=t)):
            return t
        case Literal(value=bool(b)):
            return "TRUE" if b else "FALSE"
        case Literal(value=str(s)):
            return '"' + s.replace('"', '""') + '"'
        case Literal(value=v):
            return spell_number(v)
        case Ref(sheet=s, start=a, end=b):
            return (f"{s}!" if s else "") + _cell(a) + (f":{_cell(b)}" if b else "")
        case NameRef(name=n):
            return n
        case TableRef(table=t, selector=s, current_row=now):
            return f"{t or ''}[{'@' * now}{s.replace(']', ']]')}]"
        case Call(name=n, args=args):
            return f"{n}({','.join(map(canonical, args))})"
        case Unary(op=op, operand=x):
            return op + wrap(x, 5)
        case Binary(op="^", left=a, right=b):
            return f"{wrap(a, 7)}^{wrap(b, 5)}"
        case Binary(op=op, left=a, right=b):
            own = _strength(node)
            return wrap(a, own + (own == 1)) + op + wrap(b, own + 1)
    raise TypeError(node)


def walk(node):
    """The node and all below it."""
    yield node
    match node:
        case Call(args=args):
            for a in args:
                yield from walk(a)
        case Unary(operand=x):
            yield from walk(x)
        case Binary(left=a, right=b):
            yield from walk(a)
            yield from walk(b)


def shifted(node, d_col: int, d_row: int):
    """The tree as a fill sees it: relative axes move, fixed ones stay; a corner off the sheet makes the reference #REF!."""

    def corner(c: CellRef) -> CellRef:
        return CellRef(c.col if c.fixed_col else c.col + d_col, c.row if c.fixed_row else c.row + d_row, c.fixed_col, c.fixed_row)

    match node:
        case Ref(sheet=s, start=a, end=b):
            a, b = corner(a), b and corner(b)
            if any(c and (c.col < 1 or c.row < 1) for c in (a, b)):
                return Literal(Error("#REF!"))
            return Ref(s, a, b)
        case Call(name=n, args=args):
            return Call(n, tuple(shifted(x, d_col, d_row) for x in args))
        case Unary(op=op, operand=x):
            return Unary(op, shifted(x, d_col, d_row))
        case Binary(op=op, left=a, right=b):
            return Binary(op, shifted(a, d_col, d_row), shifted(b, d_col, d_row))
    return node


