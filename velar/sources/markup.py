"""XML of office files by byte ranges: elements are found by an event parser, edits are cuts and pastes in the bytes.

What isn't edited stays byte for byte as it was, namespaces and prefixes included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

_TAG = re.compile(rb"""<(?:"[^"]*"|'[^']*'|[^>"'])*>""")


@dataclass
class Element:
    """name and attributes without namespaces; start and end of the whole, inner start and end of what it holds."""

    name: str
    attributes: dict[str, str]
    start: int
    inner_start: int
    inner_end: int = 0
    end: int = 0
    text: str = ""
    parents: tuple[int, ...] = field(default_factory=tuple)

    @property
    def empty(self) -> bool:
        return self.inner_start == self.end


def _local(name: str) -> str:
    return name.rpartition(" ")[2]


def elements(data: bytes) -> list[Element]:
    """All elements in document order; parents are places in the list, the outermost first. ExpatError if it isn't XML."""
    out: list[Element] = []
    open_: list[int] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def begin(name: str, attributes: dict[str, str]) -> None:
        at = parser.CurrentByteIndex
        out.append(Element(_local(name), {_local(k): v for k, v in attributes.items()}, at, _TAG.match(data, at).end(), parents=tuple(open_)))
        open_.append(len(out) - 1)

    def finish(name: str) -> None:
        e, at = out[open_.pop()], parser.CurrentByteIndex
        if data[e.inner_start - 2 : e.inner_start] == b"/>":
            e.inner_end = e.end = e.inner_start
        else:
            e.inner_end, e.end = at, _TAG.match(data, at).end()

    def text(value: str) -> None:
        if open_:
            out[open_[-1]].text += value

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, finish, text
    parser.Parse(data, True)
    return out


def edited(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """The bytes with each range (start, end, new) replaced; of ranges that overlap the first by place, then the longest."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += (data[at:start], new)
            at = end
    return b"".join(out) + data[at:]


def without_attributes(data: bytes, e: Element, drop) -> list[tuple[int, int, bytes]]:
    """Edits that take those attributes from an element's tag whose local name drop() is true of."""
    tag = data[e.start : e.inner_start]
    found = re.finditer(rb"""\s+([^\s=<>/]+)\s*=\s*(?:"[^"]*"|'[^']*')""", tag)
    return [(e.start + m.start(), e.start + m.end(), b"") for m in found if drop(m[1].decode().rpartition(":")[2])]


def text_edit(e: Element, new: str) -> tuple[int, int, bytes]:
    """An edit that gives an element another text."""
    return e.inner_start, e.inner_end, escape(new).encode()


def spliced(pieces: list[str], spans: list[tuple[int, int, str | None]], block: str, shortest: int) -> list[str]:
    """Pieces of one text after edits by places in the whole: what is new stands in the piece where its span begins.

    Spans go in order of place; of overlapping ones the later begins where the earlier ended; a null text is blocks.
    """
    out, at, cursor, todo = [], 0, 0, []
    total = sum(map(len, pieces))
    for start, end, new in sorted(spans, key=lambda s: (s[0], s[1])):
        start, end = max(start, cursor, 0), min(end, total)
        if start < end:
            todo.append((start, end, block * max(shortest, end - start) if new is None else new))
            cursor = end
    for piece in pieces:
        text, here, end = "", at, at + len(piece)
        for a, b, new in todo:
            if b <= at or a >= end:
                continue
            if a >= at:
                text += piece[here - at : a - at] + new
            here = min(b, end)
        out.append(text + piece[here - at :])
        at = end
    return out
