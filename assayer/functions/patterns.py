"""Regular expressions with the meaning of an engine without look-around, over Java's.

In the dialect of the rules ``$`` is the end of the text, ``\\d \\w \\s \\b`` know
Unicode, and look-around, back-references, atomic groups and possessive quantifiers
don't exist.  Java is told so by flags and by rewriting ``$``; what it would
accept beyond the dialect is refused when the rule is built.
"""

from __future__ import annotations

import re

from assayer.errors import PatternError

# What the named string rules look for.
NAMED = {
    "is_numeric": r"^\d+$",
    "is_alpha": r"^[a-zA-Z]+$",
    "is_alphanumeric": r"^[a-zA-Z0-9]+$",
    "is_lowercase": r"^[a-z0-9\s-]+$",
    "is_uppercase": r"^[A-Z0-9\s-]+$",
    "is_url": r"^https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "is_email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "is_uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
FLAGS = {"i": "iu", "m": "m", "s": "s", "x": "x", "u": "", "U": None}


def translate(pattern: str, flags: str | None = None) -> str:
    """The pattern for ``rlike``; PatternError if the dialect has no such pattern."""
    chosen = ["U"]
    for flag in flags or "":
        if FLAGS.get(flag) is None:
            raise PatternError(f"unknown flag {flag!r} for {pattern!r}")
        chosen.append(FLAGS[flag])
    many = "m" in (flags or "")
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise PatternError(f"{pattern!r} ends in a backslash")
            after = pattern[i + 1]
            if after.isdigit() and not in_class or after in "kGZQER":
                raise PatternError(f"\\{after} isn't supported in {pattern!r}")
            out.append("\\z" if after == "z" else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if c == "[":
                in_class += 1
                if not pattern.startswith("[:", i):
                    out.append(c)
                    i += 1
                    continue
                end = pattern.find(":]", i)
                if end < 0:
                    raise PatternError(f"unclosed class in {pattern!r}")
                out.append({"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "lower": "a-z", "upper": "A-Z", "space": r"\t\n\x0B\f\r ", "xdigit": "0-9a-fA-F", "word": "0-9A-Za-z_"}.get(pattern[i + 2 : end]) or _refuse(pattern))
                in_class -= 1
                i = end + 2
                continue
            if c == "]":
                in_class -= 1
            out.append(c)
        elif c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):
                out.append("\\]")
                i += 1
            continue
        elif c == "$" and not many:
            out.append("\\z")
        elif c == "(" and re.match(r"\(\?(=|!|<=|<!|>)", pattern[i:]):
            raise PatternError(f"look-around and atomic groups aren't supported: {pattern!r}")
        elif c == "(" and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c == "+" and i and pattern[i - 1] in "*+?}" and (i < 2 or pattern[i - 2] != "\\"):
            raise PatternError(f"possessive quantifiers aren't supported: {pattern!r}")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError(f"unclosed class in {pattern!r}")
    body = "".join(out)
    try:
        re.compile(body.replace("\\z", "\\Z").replace("(?<", "(?P<"))
    except re.error as e:
        if not re.search(r"\\[pPhHvVRX]|\(\?[a-z-]*[Uu]|&&|\[[^\]]*\[", body):  # what only Java knows is left to Java
            raise PatternError(f"{pattern!r}: {e}") from e
    return f"(?{''.join(dict.fromkeys(''.join(chosen)))}){body}"


def _refuse(pattern: str) -> str:
    raise PatternError(f"unknown class in {pattern!r}")
