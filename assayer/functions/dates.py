"""strftime formats as Spark's date patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.errors import PatternError

# Strftime codes and the pattern letters that read them, with one digit or two as the dialect allows.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "e": "d", "b": "MMM", "h": "MMM", "B": "MMMM", "j": "D",
    "H": "H", "I": "h", "M": "m", "S": "s", "p": "a", "f": "SSSSSS", "F": "yyyy-M-d", "D": "M/d/yy", "T": "H:m:s", "R": "H:m", "n": "\n", "t": "\t",
}


#: A weekday, which Spark can write but not read: %a is its three letters, %A also the whole name.
DAYS = {"mon": "day", "tue": "sday", "wed": "nesday", "thu": "rsday", "fri": "day", "sat": "urday", "sun": "day"}
WEEKDAYS = {"a": "|".join(DAYS), "A": "|".join(f"{short}(?:{rest})?" for short, rest in DAYS.items())}
#: Two-digit years from this one on are of the last century.
PIVOT = 70
LETTERS = frozenset("bhBpaA")


def _pieces(strftime: str) -> list[tuple[str, str]]:
    """("text", literal) and ("code", letter) in order; PatternError for a code that isn't known."""
    out, i = [], 0
    while i < len(strftime):
        c = strftime[i]
        if c != "%":
            out.append(("text", c))
            i += 1
            continue
        code = strftime[i + 1 : i + 2]
        i += 2
        if code in ("-", "_", "0"):  # padding: reading takes one digit or two anyway
            code = strftime[i : i + 1]
            i += 1
        if code == "%":
            out.append(("text", "%"))
        elif code in CODES or code in WEEKDAYS:
            out.append(("code", code))
        else:
            raise PatternError(f"%{code} in the date format {strftime!r} isn't supported")
    return out


def date_pattern(strftime: str) -> str:
    """The pattern for ``to_date``, weekdays left out; PatternError for a code that it can't read."""
    out, literal = [], []

    def flush() -> None:
        if literal:
            text = "".join(literal)
            out.append(f"'{text.replace(chr(39), chr(39) * 2)}'" if any(c.isalpha() or c in "'[]{}#" for c in text) else text)
            literal.clear()

    for kind, piece in _pieces(strftime):
        if kind == "text":
            literal.append(piece)
        elif piece not in WEEKDAYS:
            flush()
            out.append(CODES[piece])
    flush()
    return "".join(out)


def _with_weekday(pieces: list[tuple[str, str]]) -> str:
    """A regular expression for text of the format, with a group for each weekday and each part between."""
    out = ["("]
    for kind, piece in pieces:
        if kind == "text":
            out.append(re.escape(piece))
        elif piece in WEEKDAYS:
            out.append(f")({WEEKDAYS[piece]})(")
        else:
            out.append("[A-Za-z]+" if piece in LETTERS else r"[0-9:/\s-]+")
    return "(?i)^" + "".join(out) + r")\z"


def parse_date(raw: Column, strftime: str) -> Column:
    """The date that the text gives, null where it gives none or another weekday than it says."""
    pieces, pattern = _pieces(strftime), date_pattern(strftime)
    codes = [piece for kind, piece in pieces if kind == "code"]
    days = sum(c in WEEKDAYS for c in codes)
    text = raw
    if days:
        shape = F.lit(_with_weekday(pieces))
        text = F.when(F.regexp_like(raw, shape), F.concat(*(F.regexp_extract(raw, _with_weekday(pieces), 2 * i + 1) for i in range(days + 1))))
    date = F.try_to_date(text, pattern)
    if {"y", "D"} & {*codes} and not {"Y", "F"} & {*codes}:
        date = F.when(F.year(date) >= 2000 + PIVOT, F.add_months(date, -1200)).otherwise(date)
    for i in range(days):
        said = F.lower(F.substring(F.regexp_extract(raw, _with_weekday(pieces), 2 * i + 2), 1, 3))
        # Monday is day 0.
        date = F.when(F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(date) + 1) == said, date)
    return date
