"""Word and Excel files with edits made and everything private taken out.

Edits name blocks by the numbers that velar.sources.ooxml.blocks gives them. A file that can't be opened has an error
and no content. Names of results say nothing about the source.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velar.functions.formulas import renamed
from velar.operators.redact import BLOCK, SHORTEST_BLOCK
from velar.sources import ooxml
from velar.sources.markup import edited, elements, spliced, text_edit, without_attributes

#: Members of packages that are private, by how their names begin or end; a member's date.
PRIVATE = ("docprops/", "customxml/", "word/comments", "word/people", "word/printersettings/", "xl/comments", "xl/threadedcomments/", "xl/persons/", "xl/drawings/commentsdrawing", "xl/printersettings/")
PRIVATE_END = ("/thumbnail.jpeg", "/thumbnail.jpg", "/thumbnail.png")
LONGEST_ENTITY = 16  # bytes that one character takes at most, as an entity or otherwise
FIRST_DATE = (1980, 1, 1, 0, 0, 0)
GONE = {"del", "moveFrom", "commentRangeStart", "commentRangeEnd", "commentReference", "docVars", "dataBinding", "trackRevisions"}
OPENED = {"ins", "moveTo", "customXml"}
PIECE, LONGEST_TITLE = 8 << 20, 31  # bytes of a member searched at a time; characters of a sheet's title
#: Elements whose text is a formula, in sheets, workbooks, charts and drawings.
FORMULAS = {"f", "definedName", "formula1", "formula2", "formula"}
Spans = list[tuple[int, int, str | None]]


def is_private(name: str) -> bool:
    low = name.lower().lstrip("/")
    return low.startswith(PRIVATE) or low.endswith(PRIVATE_END)


def _target(rels: str, target: str) -> str:
    """The member that a relationship points to."""
    folder = posixpath.dirname(posixpath.dirname(rels))
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))


def _source(rels: str) -> str:
    """The member whose relationships these are."""
    return posixpath.join(posixpath.dirname(posixpath.dirname(rels)), posixpath.basename(rels).removesuffix(".rels"))


def sanitised(members: dict[str, bytes]) -> dict[str, bytes]:
    """The members without private ones, links to the outside, what was deleted, comments, and traces of editors.

    What was inserted stays as plain text. Members that aren't XML stay as they are.
    """
    out = {n: d for n, d in members.items() if not is_private(n)}
    lost: dict[str, set[str]] = {}
    for name, data in out.items():
        try:
            if name.endswith(".rels"):
                gone = [e for e in elements(data) if e.name == "Relationship" and (e.attributes.get("TargetMode", "").lower() == "external" or is_private(_target(name, e.attributes.get("Target", ""))))]
                lost.setdefault(_source(name), set()).update(e.attributes.get("Id", "") for e in gone)
                out[name] = edited(data, [(e.start, e.end, b"") for e in gone])
            elif name == "[Content_Types].xml":
                out[name] = edited(data, [(e.start, e.end, b"") for e in elements(data) if is_private(e.attributes.get("PartName", "") or "-")])
        except ExpatError:
            continue
    for name, data in out.items():
        if not name.endswith(".xml") or not (name.startswith("word/") or lost.get(name)):
            continue
        try:
            found = elements(data)
        except ExpatError:
            continue
        ids, edits = lost.get(name, set()), []
        for e in found:
            if name.startswith("word/") and e.name in GONE or e.name in ("legacyDrawing", "legacyDrawingHF") and e.attributes.get("id") in ids:
                edits.append((e.start, e.end, b""))
                continue
            if name.startswith("word/") and e.name in OPENED:
                edits += [(e.start, e.inner_start, b""), (e.inner_end, e.end, b"")]
                continue
            if name.startswith("word/"):
                edits += without_attributes(data, e, lambda a: a.lower().startswith("rsid") or a.lower() in ("author", "date", "initials"))
            if e.attributes.get("id") in ids or e.attributes.get("link") in ids:
                edits += without_attributes(data, e, lambda a, e=e: a in ("id", "link", "embed") and e.attributes.get(a) in ids)
        out[name] = edited(data, edits)
    return out


def packed(members: dict[str, bytes]) -> bytes:
    """A package of the members, all of them of the same date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in members.items():
            info = zipfile.ZipInfo(name, FIRST_DATE)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o600 << 16
            package.writestr(info, data)
    return out.getvalue()


def word_redacted(members: dict[str, bytes], edits: dict[int, Spans]) -> dict[str, bytes]:
    """The members with edits of paragraphs made in their runs; links of edited paragraphs point nowhere."""
    out, i = dict(members), 0
    for part, _ in ooxml.word_parts(members):
        data = members[part]
        found, changes = elements(data), []
        for p, runs in ooxml.paragraphs(found):
            if spans := edits.get(i):
                new = spliced([ooxml.run_text(r) for r in runs], spans, BLOCK, SHORTEST_BLOCK)
                changes += [text_edit(r, t) for r, t in zip(runs, new) if r.name == "t" and not r.empty and t != r.text]
                links = [e for e in found if e.name == "hyperlink" and p.start < e.start < p.end]
                changes += [c for e in links for c in without_attributes(data, e, lambda a: a == "id")]
            i += 1
        out[part] = edited(data, changes)
    return out


def _title(text: str, taken: set[str]) -> str:
    """A sheet's title without characters that Excel bars, short enough, and unlike the others."""
    base = re.sub(r"[\\/*?:\[\]]", "-", text).strip()[:LONGEST_TITLE] or "Sheet"
    title, k = base, 2
    while title.casefold() in taken:
        title, k = base[: LONGEST_TITLE - len(f" ({k})")] + f" ({k})", k + 1
    return title


def excel_redacted(members: dict[str, bytes], edits: dict[int, Spans]) -> dict[str, bytes]:
    """The members with edits of titles, cells and print headers made; links of cells and strings nobody shows are gone.

    A new title is carried into all formulas that name the old one.

    Spans are places in what a block shows. Text cells are edited in part; numbers, dates and formulas become text as a
    whole: the first replacement, or blocks.
    """
    out, changes, titles = dict(members), {}, {}
    headers: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for i, (part, e, origin, sheet, _, zone, formula, text, kind, _, _) in enumerate(ooxml.excel_blocks(members)):
        if not (spans := edits.get(i)):
            continue
        new = spliced([text], spans, BLOCK, SHORTEST_BLOCK)[0]
        if origin == "title":
            titles[sheet] = new
        elif origin == "cell":
            if formula or kind != "text":
                new = next((s[2] for s in spans if s[2] is not None), BLOCK * max(SHORTEST_BLOCK, len(text)))
            keep = "".join(f" {a}={quoteattr(e.attributes[a])}" for a in ("r", "s") if a in e.attributes)
            tag = members[part][e.start : e.start + 40].split(b"<", 1)[1]
            p = re.match(rb"[\w.]*:", tag)
            p = p[0].decode() if p else ""
            cell = f'<{p}c{keep} t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(new)}</{p}t></{p}is></{p}c>'
            changes.setdefault(part, []).append((e.start, e.end, cell.encode()))
        else:
            headers.setdefault((part, e.start), []).append((zone, new))
    for (part, start), parts in headers.items():
        e = next(x for x in elements(members[part]) if x.start == start)
        new = dict(parts)
        text = "".join(f"&{letter}{new.get('LCR'.index(letter), old)}" for letter, old in ooxml.zones(e.text))
        changes.setdefault(part, []).append(text_edit(e, text))
    renames, new_names = _renamed_sheets(members["xl/workbook.xml"], titles)
    for name, data in members.items():
        if name == "xl/workbook.xml" or not new_names or not re.match(r"xl/.*\.xml\Z", name):
            continue
        if more := _formula_edits(data, new_names):
            changes.setdefault(name, []).extend(more)
    sheets = {part for _, part, _ in ooxml.sheet_parts(members)}
    for part in sheets | changes.keys():
        links = [(e.start, e.end, b"") for e in elements(members[part]) if e.name == "hyperlinks"] if part in sheets else []
        out[part] = edited(members[part], changes.get(part, []) + links)
    if "xl/sharedStrings.xml" in members:
        shown: set[int] = set()
        for _, part, _ in ooxml.sheet_parts(members):
            found = elements(out[part])
            shown |= {int(e.text) for e in found if e.name == "v" and found[e.parents[-1]].attributes.get("t") == "s"}
        strings = elements(members["xl/sharedStrings.xml"])
        number = {k: n for n, k in enumerate(k for k, e in enumerate(strings) if e.name == "si")}
        unseen = [e for e in strings if e.name == "t" and not e.empty and number[next(p for p in e.parents if p in number)] not in shown]
        out["xl/sharedStrings.xml"] = edited(members["xl/sharedStrings.xml"], [text_edit(e, "") for e in unseen])
    if titles:
        out["xl/workbook.xml"] = edited(members["xl/workbook.xml"], renames + _formula_edits(members["xl/workbook.xml"], new_names))
    return out


def _renamed_sheets(book: bytes, titles: dict[str, str]) -> tuple[list[tuple[int, int, bytes]], dict[str, str]]:
    """Edits of the workbook's list of sheets, and each old title, in small letters, with its new one."""
    sheets = [e for e in elements(book) if e.name == "sheet"] if titles else []
    taken, edits, names = {e.attributes["name"].casefold() for e in sheets if e.attributes["name"] not in titles}, [], {}
    for e in sheets:
        if (old := e.attributes["name"]) in titles:
            new = names[old.casefold()] = _title(titles[old], taken)
            taken.add(new.casefold())
            tag = re.sub(rb"""(\sname\s*=\s*)("[^"]*"|'[^']*')""", lambda m, new=new: m[1] + quoteattr(new).encode(), book[e.start : e.inner_start], count=1)
            edits.append((e.start, e.inner_start, tag))
    return edits, names


def _formula_edits(data: bytes, names: dict[str, str]) -> list[tuple[int, int, bytes]]:
    """Edits that give renamed sheets their new names in the formulas of a member: cells', names', rules', charts', pivots'."""
    try:
        found = elements(data)
    except ExpatError:
        return []
    out = [text_edit(e, new) for e in found if e.name in FORMULAS and not e.empty and (new := renamed(e.text, names)) != e.text]
    for e in found:
        if e.name == "worksheetSource" and (new := names.get(e.attributes.get("sheet", "").casefold())):
            tag = re.sub(rb"""(\ssheet\s*=\s*)("[^"]*"|'[^']*')""", lambda m, new=new: m[1] + quoteattr(new).encode(), data[e.start : e.inner_start], count=1)
            out.append((e.start, e.inner_start, tag))
    return out


def found_in_package(members: dict[str, bytes], texts: list[str]) -> list[str]:
    """Those of the texts that some member still holds: as text in any letter case, or as UTF-8 or UTF-16 bytes.

    Members of any size are searched, in pieces that overlap by more than the longest text takes in any writing.
    """
    left, out = [t.strip() for t in texts if t and t.strip()], set()
    forms = {t: (t.casefold(), [t.encode(c, "ignore") for c in ("utf-8", "utf-16le", "utf-16be")]) for t in left}
    lap = LONGEST_ENTITY * max(map(len, left), default=0) + LONGEST_ENTITY
    for name, data in members.items():
        is_text = name.lower().endswith((".xml", ".rels", ".txt"))
        for at in range(0, len(data), PIECE):
            piece = data[max(0, at - lap) : at + PIECE]
            plain = html.unescape(piece.decode(errors="ignore")).casefold() if is_text else ""
            out |= {t for t in left if t not in out and (forms[t][0] in plain or any(f in piece for f in forms[t][1]))}
    return [t for t in left if t in out]


RESULT = "path string, name string, content binary, sha256 string, error string"


def redacted_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """RESULT: each of files (path, content, error) with its edits (path, block_id, edits) made, sanitised and packed.

    edits holds array<struct<start,end,replacement>> for blocks; unknown blocks are ignored. A file without edits is
    sanitised all the same. name is made of the result's hash.
    """
    by_file = edits.groupBy("path").agg(F.collect_list(F.struct("block_id", "edits")).alias("edits"))
    joined = files.join(by_file, "path", "left").select("path", "content", "error", "edits")

    def run(batches):
        for batch in batches:
            out = []
            for path, content, error, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                made = None
                if content is not None:
                    try:
                        members = ooxml.opened(content)
                        spans = {x["block_id"]: [(s["start"], s["end"], s["replacement"]) for s in x["edits"]] for x in wanted or []}
                        make = word_redacted if "word/document.xml" in members else excel_redacted
                        made = packed(sanitised(make(members, spans)))
                    except ooxml.UNREADABLE as e:
                        error = f"unreadable: {type(e).__name__}"
                out.append((path, made, error))
            path, made, error = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(made, pa.binary()), pa.array(error, pa.string())], names=["path", "content", "error"])

    done = joined.mapInArrow(run, "path string, content binary, error string").withColumn("sha256", F.sha2("content", 256))
    kind = F.element_at(F.split("path", r"\."), -1)
    return done.select("path", F.concat(F.lit("redacted-"), F.substring("sha256", 1, 16), F.lit("."), kind).alias("name"), "content", "sha256", "error")


def package_leftovers(results: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, text): approved texts (path, text) that a result's package still holds in some member."""
    by_file = texts.groupBy("path").agg(F.collect_set("text").alias("texts"))
    joined = results.where("content is not null").join(by_file, "path").select("path", "content", "texts")

    def run(batches):
        for batch in batches:
            rows = [(p, t) for p, c, ts in zip(*(batch.column(i).to_pylist() for i in range(3))) for t in found_in_package(ooxml.opened(c), ts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["path", "text"])

    return joined.mapInArrow(run, "path string, text string")
