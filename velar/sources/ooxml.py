"""Word and Excel files as text blocks: one row per paragraph or cell, from a DataFrame of binary files.

Files are read by Spark's binaryFile source and opened in memory in the tasks; a file that is no such package, is too
large inflated, or has too many members gives one row with an error and no text.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velar.sources.markup import Element, elements

MOST_BYTES, MOST_MEMBERS, BATCH_BLOCKS = 500 << 20, 100_000, 10_000
KINDS = ["docx", "xlsx"]
UNREADABLE = (zipfile.BadZipFile, KeyError, ExpatError, AttributeError, ValueError, IndexError, NotImplementedError)
BLOCKS = "path string, block_id int, origin string, sheet string, row int, col int, is_formula boolean, text string, kind string, number_format string, hidden boolean, error string"
#: Number formats that are built in and show dates, and those that show times.
DATE_FORMATS, TIME_FORMATS = {14, 15, 16, 17, 22}, {18, 19, 20, 21, 45, 46, 47}
FIELDS = ["oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter"]


def files(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """(path, content, error) of the Word and Excel files below a folder; larger ones have an error and no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(path)
    fits = F.col("length") <= most_bytes
    return found.select("path", F.when(fits, F.col("content")).alias("content"), F.when(~fits, "too large").alias("error"))


def rejects(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """(path, reason) of the files below a folder that files() can't take: other kinds, older kinds, too large ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reason = F.when(kind.isin("doc", "xls", "xlsm"), F.concat(F.lit("save as a newer kind than "), kind)).when(~kind.isin(KINDS), F.concat(F.lit("unknown kind "), kind)).when(F.col("length") > most_bytes, "too large")
    return found.select("path", reason.alias("reason")).where("reason is not null")


def opened(content: bytes) -> dict[str, bytes]:
    """The members of a package by name. ValueError if it is too large inflated or has too many."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        members = package.infolist()
        if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_BYTES:
            raise ValueError("package too large")
        return {m.filename: package.read(m) for m in members if not m.is_dir()}


def word_parts(members: dict[str, bytes]) -> Iterator[tuple[str, str]]:
    """(part, origin): the body with tables and text boxes, then headers and footers."""
    yield "word/document.xml", "body"
    for name in sorted(members):
        if m := re.fullmatch(r"word/(header|footer)\d*\.xml", name):
            yield name, m[1]


def paragraphs(found: list[Element]) -> Iterator[tuple[Element, list[Element]]]:
    """(paragraph, its runs of text, tabs and breaks) of each paragraph with text; text boxes inside have their own."""
    runs: dict[int, list[Element]] = {}
    places = {i for i, e in enumerate(found) if e.name == "p"}
    for e in found:
        if e.name in ("t", "tab", "br") and (own := [p for p in e.parents if p in places]):
            runs.setdefault(own[-1], []).append(e)
    for i in sorted(places):
        if any(e.name == "t" and e.text.strip() for e in runs.get(i, [])):
            yield found[i], runs[i]


def run_text(run: Element) -> str:
    return run.text if run.name == "t" else " "


def column_number(letters: str) -> int:
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return col


def sheet_parts(members: dict[str, bytes]) -> Iterator[tuple[str, str, bool]]:
    """(title, part, hidden) of each sheet."""
    targets = {e.attributes.get("Id"): e.attributes.get("Target") for e in elements(members["xl/_rels/workbook.xml.rels"]) if e.name == "Relationship"}
    for e in elements(members["xl/workbook.xml"]):
        if e.name == "sheet":
            target = targets[e.attributes["id"]].lstrip("/")
            yield e.attributes["name"], target if target.startswith("xl/") else f"xl/{target}", e.attributes.get("state", "visible") != "visible"


def shared_strings(members: dict[str, bytes]) -> list[str]:
    if "xl/sharedStrings.xml" not in members:
        return []
    out: list[str] = []
    for e in elements(members["xl/sharedStrings.xml"]):
        if e.name == "si":
            out.append("")
        elif e.name == "t":
            out[-1] += e.text
    return out


def number_formats(members: dict[str, bytes]) -> list[tuple[int, str]]:
    """(id, code) of the number format of each cell style."""
    if "xl/styles.xml" not in members:
        return []
    found = elements(members["xl/styles.xml"])
    codes = {int(e.attributes["numFmtId"]): e.attributes.get("formatCode", "") for e in found if e.name == "numFmt"}
    styles = [e for e in found if e.name == "xf" and e.parents and found[e.parents[-1]].name == "cellXfs"]
    ids = [int(e.attributes.get("numFmtId", 0)) for e in styles]
    return [(i, codes.get(i, "")) for i in ids]


def shown_number(value: str, number: int, code: str) -> tuple[str, str]:
    """(kind, value): numbers with a format of dates or times as ISO timestamps, days from the end of 1899 on."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    date, time = number in DATE_FORMATS or bool(re.search("[dy]", plain)), number in TIME_FORMATS or bool(re.search("[hs]", plain))
    if not date and not time:
        return "number", value
    at = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(value) * 86400))
    return "date" if date else "time", at.isoformat(sep=" ")


def cells(members: dict[str, bytes], found: list[Element], shared: list[str], formats: list[tuple[int, str]]) -> Iterator[tuple[Element, int, int, bool, str, str, str]]:
    """(element, row, column, is a formula, text, kind, format code) of each cell of a sheet that isn't empty."""
    inside: dict[int, dict[str, str]] = {}
    for e in found:
        if e.name in ("v", "t", "f"):
            cell = next((p for p in reversed(e.parents) if found[p].name == "c"), None)
            if cell is not None:
                values = inside.setdefault(cell, {})
                values[e.name] = values.get(e.name, "") + e.text
    for i, e in enumerate(found):
        if e.name != "c":
            continue
        values, t = inside.get(i, {}), e.attributes.get("t", "n")
        text = values.get("t") if t == "inlineStr" else values.get("v")
        kind, code = "text", ""
        if text is not None and t == "s":
            text = shared[int(text)]
        elif text and t == "n":
            number, code = formats[int(e.attributes["s"])] if "s" in e.attributes and formats else (0, "")
            kind, text = shown_number(text, number, code)
        if text and text.strip():
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", e.attributes["r"]).groups()
            yield e, int(row), column_number(letters), "f" in values, text, kind, code


def zones(text: str) -> list[tuple[str, str]]:
    """(letter, text) of the left, middle and right part of a print header or footer."""
    parts = re.split(r"&([LCR])", text)
    first = [("C", parts[0])] if parts[0] else []
    return first + list(zip(parts[1::2], parts[2::2]))


def excel_blocks(members: dict[str, bytes]) -> Iterator[tuple]:
    """(part, element, origin, sheet, row, column, formula, text, kind, format, hidden) of titles, cells, print headers."""
    shared, formats = shared_strings(members), number_formats(members)
    for title, part, hidden in sheet_parts(members):
        yield part, None, "title", title, 0, 0, False, title, "text", "", hidden
        found = elements(members[part])
        rows = {int(e.attributes["r"]) for e in found if e.name == "row" and e.attributes.get("hidden") in ("1", "true") and "r" in e.attributes}
        spans = [(int(e.attributes["min"]), int(e.attributes["max"])) for e in found if e.name == "col" and e.attributes.get("hidden") in ("1", "true")]
        for e, row, col, formula, text, kind, code in cells(members, found, shared, formats):
            unseen = hidden or row in rows or any(a <= col <= b for a, b in spans)
            yield part, e, "cell", title, row, col, formula, text, kind, code, unseen
        for e in found:
            if e.name in FIELDS:
                for letter, text in zones(e.text):
                    if text.strip():
                        yield part, e, "header" if e.name.endswith("Header") else "footer", title, FIELDS.index(e.name), "LCR".index(letter), False, text, "text", "", hidden


def blocks(found: DataFrame, most_cells: int | None = None) -> DataFrame:
    """BLOCKS of files(): paragraphs with their origin; cells with sheet, row, column, what they show, and their format.

    A workbook with more than most_cells blocks, if that is given, has one row with an error.

    Row 0 of a sheet is its title; its print headers and footers have the number of their field as row and that of
    their zone as column. Dates are ISO timestamps here; search.visible_value shows them as the sheet does.
    """

    def rows(path: str, content: bytes | None, error: str | None):
        none = (path, *[None] * 10)
        if content is None:
            yield (*none, error)
            return
        try:
            members = opened(content)
            if "word/document.xml" in members:
                i = 0
                for part, origin in word_parts(members):
                    for _, runs in paragraphs(elements(members[part])):
                        yield path, i, origin, None, None, None, None, "".join(map(run_text, runs)), None, None, None, None
                        i += 1
            else:
                made = list(excel_blocks(members))  # whole, so that a broken file gives nothing but its error
                if most_cells is not None and len(made) > most_cells:
                    yield (*none, "too many cells")
                    return
                for i, (_, _, origin, *rest) in enumerate(made):
                    yield path, i, origin, *rest, None
        except UNREADABLE as e:
            yield (*none, str(e) if "too large" in str(e) else f"unreadable: {type(e).__name__}")

    def run(batches):
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        names, types = zip(*(x.split() for x in BLOCKS.split(", ")))
        for batch in batches:
            for path, content, error in zip(*(batch.column(i).to_pylist() for i in range(3))):
                each = rows(path, content, error)
                while made := list(islice(each, BATCH_BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*made), types)], names=list(names))

    return found.select("path", "content", "error").mapInArrow(run, BLOCKS)
