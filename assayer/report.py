"""Reports on results: a console report and a JSON document."""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterable
from pathlib import Path
from typing import Any, TextIO

from assayer.results import RuleResult, ValidationResult

VERSION = "0.1.0"


def short_number(n: int) -> str:
    """1,500 as 1.5K; an exact thousand, million or billion stays in the unit below."""
    for size, letter in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n > size:
            return f"{n / size:.1f}{letter}"
    return str(n)


class Reporter:
    """Is told of each step of a run; a method named like the step, if there is one, gets its facts.

    Steps: ``table`` (number, of, name), ``result`` (result), ``end`` (passed, failed), ``idle``.
    """

    def tell(self, step: str, **facts: Any) -> None:
        if method := getattr(self, step, None):
            method(**facts)


class ConsoleReporter(Reporter):
    """One line for each rule: its verdict, name, share of errors and what it may be."""

    def __init__(self, brief: bool = False, out: TextIO | None = None):
        self.brief, self.out = brief, out or sys.stdout

    def _print(self, *lines: str) -> None:
        print(*lines, sep="\n", file=self.out)

    def table(self, number: int, of: int, name: str) -> None:
        self._print(f"({number} of {of}) {name}")

    def result(self, result: ValidationResult) -> None:
        good, rules = result.is_passed()
        self._print(f"== {result.table_name}: {'ok' if result.passed else 'not ok'}, {good} of {rules} rules hold on {short_number(result.total_rows)} rows")
        if not self.brief:
            self._print(*(line for group in (result.columns, result.relations) for target, found in group.items() for line in self._lines(target, found)))
        self._print(*(f"   note: {w}" for w in result.warnings))

    @staticmethod
    def _lines(target: str, rules: list[RuleResult]) -> list[str]:
        out = [f"   {target}"]
        for r in rules:
            found = r.error_message or f"{short_number(r.error_count)} errors, {r.error_percentage:.2f} % (allowed {r.threshold:g} %)"
            out.append(f"     {'+' if r.passed else '-'} {r.rule_name}: {found}")
        return out

    def end(self, passed: int, failed: int) -> None:
        self._print(f"Tables: {passed} ok, {failed} not ok")

    def idle(self) -> None:
        self._print("Watching the file.")


class JsonReporter(Reporter):
    """Gathers results and writes one document at the end."""

    def __init__(self, path: str | None = None, brief: bool = False):
        self.path, self.brief, self.tables = path, brief, []
        self.now = dt.datetime.now()
        self.written: Path | None = None

    # The document's keys are a format that other programs read.
    @staticmethod
    def _rules(rules: Iterable[RuleResult]) -> list[dict]:
        out = []
        for r in rules:
            row = {"name": r.rule_name, "errors": r.error_count, "error_percent": r.error_percentage, "threshold": r.threshold, "pass": r.passed}
            out.append(row | ({"error_message": r.error_message} if r.error_message else {}))
        return out

    def result(self, result: ValidationResult) -> None:
        table: dict = {"name": result.table_name, "n_rows": result.total_rows, "pass": result.passed}
        if not self.brief:
            table["columns"] = [{"name": n, "rules": self._rules(rs)} for n, rs in result.columns.items()]
            if result.relations:
                table["relations"] = [{"name": n, "rules": self._rules(rs)} for n, rs in result.relations.items()]
        self.tables.append(table)

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "timestamp": f"{self.now:%Y-%m-%d %H:%M:%S}", "tables": self.tables}, indent=2)

    def end(self, passed: int, failed: int) -> None:
        self.written = target_path(self.path or ".", f"validation_{self.now:%Y%m%d-%H%M%S}.json")
        self.written.write_text(self.to_json())


def target_path(path: str, name: str) -> Path:
    """A folder, or what ends in a slash, takes a file of that name; anything else is the file."""
    target = Path(path)
    if target.is_dir() or path.endswith("/"):
        target.mkdir(parents=True, exist_ok=True)
        return target / name
    target.parent.mkdir(parents=True, exist_ok=True)
    return target
