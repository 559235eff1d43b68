"""Extensions of a workbook: the registry of what is installed, and assertions@1.

A plugin gets its opaque payload, a read-only view of the workbook and a sink for
diagnostics; it adds no formula functions.  All that a plugin may do is bounded
by ``Limits``: what goes beyond is told by a diagnostic (MS3111, or the plugin's
``limit_code``), never dropped silently.
"""

from __future__ import annotations

import json
import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame

from lattica.functions.values import DateTime, Formula, infer
from lattica.plans.formula import FormulaError, Ref, parse_area
from lattica.plans.sheets import Calculator, Key
from lattica.sources.workbook import Diagnostic, Workbook, _each, area

_LINE = re.compile(r"assert (\S+) (=|!=|<=|>=|<|>) (\S.*)")
_ORDER = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Limits:
    """Code points of a payload, its lines, and diagnostics of one instance."""

    payload: int = 1 << 20
    lines: int = 10_000
    diagnostics: int = 1_000


class View:
    """What plugins see of a workbook; all share one calculation."""

    def __init__(self, book: Workbook):
        self._book, self._calculator = book, None

    def sheets(self) -> list[str]:
        return [s.name for s in self._book.sheets]

    def value(self, key: Key):
        """Calculated value of a cell; None if it is blank or absent."""
        if self._calculator is None:
            self._calculator = Calculator(self._book)
        return self._calculator.calculate([key])[key]


Sink = Callable[[str, int, str], None]


class Plugin(Protocol):
    id: str

    def validate(self, payload: str, line: int, sheet: str | None, view: View, sink: Sink, limits: Limits) -> None: ...


class Registry:
    """Plugins by their exact id, major version included."""

    def __init__(self, *plugins: Plugin):
        self._plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if plugin.id in self._plugins:
            raise ValueError(f"{plugin.id} is registered twice")
        self._plugins[plugin.id] = plugin

    def get(self, name: str) -> Plugin | None:
        return self._plugins.get(name)


def _literal(text: str):
    """A literal's value; raises ValueError if it is none."""
    if text == "blank":
        return None
    if text[0] == '"':
        value = json.loads(text)
        if isinstance(value, str):
            return value
    value = infer(text)
    if isinstance(value, str | Formula):
        raise ValueError("no literal")
    return value


def holds(left, op: str, right) -> bool:
    """= and != by kind and value; the others need two finite numbers, dates or datetimes."""
    if op in ("=", "!="):
        return (type(left) is type(right) and left == right) == (op == "=")
    for kind in (float, date, DateTime):
        if type(left) is kind and type(right) is kind:
            a, b = (left.nanos, right.nanos) if kind is DateTime else (left, right)
            return (kind is not float or (math.isfinite(a) and math.isfinite(b))) and _ORDER[op](a, b)
    return False


class Assertions:
    """``assert <cell> <operator> <literal>``, a line each; empty lines and those that begin with ``#`` are passed over."""

    id, limit_code = "assertions@1", "MS3203"

    def validate(self, payload: str, line: int, sheet: str | None, view: View, sink: Sink, limits: Limits) -> None:
        lines = payload.split("\n")
        if len(payload) > limits.payload or len(lines) > limits.lines:
            sink(self.limit_code, line, "the payload is larger than the limit")
            return
        for at, text in enumerate(lines, line + 1):
            text = text.rstrip("\r")
            if not text or text.startswith("#"):
                continue
            try:
                m = _LINE.fullmatch(text)
                target = parse_area(m[1]) if m else None
                if not isinstance(target, Ref) or target.end is not None or (target.sheet is None) != (sheet is not None):
                    raise ValueError("no cell")
                wanted, key = _literal(m[3]), (target.sheet or sheet, *area(target)[:2])
                if key[0] not in view.sheets():
                    raise ValueError("no such sheet")
            except (ValueError, FormulaError):
                sink("MS3202", at, f"malformed assertion: {text}")
                continue
            if not holds(view.value(key), m[2], wanted):
                sink("MS3201", at, f"{m[1]} {m[2]} {m[3]} does not hold")


INSTALLED = Registry(Assertions())


def availability(book: Workbook, registry: Registry = INSTALLED) -> list[Diagnostic]:
    """MS3101 for required and MS3102 for used extensions that are not installed, by the book's own list."""
    out = []
    for kind, item in book.extensions:
        if kind != "extension" and registry.get(item) is None:
            required = kind == "require"
            out.append(Diagnostic("MS3101" if required else "MS3102", 1, f"{item} is not available", "error" if required else "warning"))
    return out


def completeness(book: Workbook, registry: Registry = INSTALLED) -> tuple[bool, bool]:
    """(calculation, rendering) is complete: nothing that is required is missing, and the text has no errors."""
    fine = not any(d.severity == "error" for d in [*book.diagnostics, *availability(book, registry)])
    return fine, fine


def validate(book: Workbook, registry: Registry = INSTALLED, limits: Limits = Limits()) -> list[Diagnostic]:
    """What the book's extensions report, by line and code; nothing for a book with errors, which cannot be calculated."""
    if any(d.severity == "error" for d in book.diagnostics):
        return []
    view, out = View(book), []
    instances = [(None, item) for kind, item in book.extensions if kind == "extension"]
    instances += [(s.name, item) for s in book.sheets for item in s.of("extension")]
    for sheet, (name, payload, line) in instances:
        plugin = registry.get(name.split(" ")[0])
        if plugin is None:
            continue
        found: list[Diagnostic] = []

        limit = getattr(plugin, "limit_code", "MS3111")

        def sink(code: str, at: int, message: str, found: list[Diagnostic] = found, line: int = line, limit: str = limit) -> None:
            if len(found) == limits.diagnostics:
                found.append(Diagnostic(limit, line, "further diagnostics are cut off"))
            elif len(found) < limits.diagnostics:
                found.append(Diagnostic(code, at, message))

        plugin.validate(payload, line, sheet, view, sink, limits)
        out += found
    return sorted(out, key=lambda d: (d.line, d.code))


def extension_diagnostics(texts: DataFrame) -> DataFrame:
    """key, code, line, message that extensions report about workbook texts (key, source)."""
    return _each(texts, lambda book: [(d.code, d.line, d.message) for d in validate(book)], "code string, line long, message string")
