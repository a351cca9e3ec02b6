"""Spreadsheet formulas as tokens, as far as names of sheets go: which sheets a formula names, and other names for them.

A sheet is named before an exclamation mark: plain (Data!A1), in quotes where the name needs them ('My Data'!A1, a
quote doubled), two of them for a run of sheets (Jan:Dec!A1), and behind the workbook's number or name in brackets if it
is another workbook's, which is left alone. Text in double quotes is no name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

_TOKEN = re.compile(
    r"""(?P<text>"(?:[^"]|"")*")"""
    r"""|'(?P<quoted>(?:[^']|'')*)'!"""
    r"""|(?P<book>\[[^\]]*\])?(?P<plain>[^\W\d][\w.]*(?::[^\W\d][\w.]*)?)!""",
)
#: A name that needs no quotes: letters, digits, dots, and neither a cell's nor a number's form.
_PLAIN = re.compile(r"[^\W\d][\w.]*\Z")
_CELL = re.compile(r"(?i)(?:[a-z]{1,3}\d+|r\d*c\d*|r|c|true|false)\Z")


def quoted_sheet(names: list[str]) -> str:
    """A sheet's name, or a run's two, as formulas write them, with the exclamation mark."""
    if all(_PLAIN.match(n) and not _CELL.match(n) for n in names):
        return ":".join(names) + "!"
    return "'" + ":".join(names).replace("'", "''") + "'!"


def renamed(formula: str, names: Mapping[str, str]) -> str:
    """The formula with sheets under their new names; names maps casefolded old names to new ones.

    What names no renamed sheet stays as it is written. A formula that isn't well formed stays from where it breaks.
    """

    def one(m: re.Match) -> str:
        if m["text"] is not None or m["book"]:
            return m[0]
        raw = m["quoted"].replace("''", "'") if m["quoted"] is not None else m["plain"]
        if raw.startswith("[") or "]" in raw:
            return m[0]
        parts = raw.split(":")
        if not any(p.casefold() in names for p in parts):
            return m[0]
        return quoted_sheet([names.get(p.casefold(), p) for p in parts])

    return _TOKEN.sub(one, formula)


def sheets_named(formula: str) -> list[str]:
    """The sheets of this workbook that a formula names, in order, runs as their two ends."""
    out = []
    for m in _TOKEN.finditer(formula):
        raw = m["plain"] if m["quoted"] is None else m["quoted"].replace("''", "'")
        if m["text"] is None and not m["book"] and raw is not None and "]" not in raw:
            out += raw.split(":")
    return out
