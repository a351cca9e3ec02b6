"""Spans of text found without a Python function.

Spark has no "find all with positions". The gaps that split() leaves and the matches that regexp_extract_all() returns
alternate, so that their lengths add up to exact positions. Positions count code points, from 0, end exclusive. A
pattern must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "struct<start:int,end:int>"
GLUED = r".,;:\-–—()\[\]"  # signs taken off the first and last token as well


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end>> of all matches, or of a group that ends each match. Null text gives an empty array."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    steps = F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLACE}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"))).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    if group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        found = F.zip_with(found, sizes, lambda s, n: F.struct((s["end"] - n).alias("start"), s["end"].alias("end")))
        found = F.filter(found, lambda s: s["start"] < s["end"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{PLACE}>"))


def literal(term: str, ignore_case: bool = True) -> str:
    """A pattern that matches the term itself."""
    return ("(?iu)" if ignore_case else "") + "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def let(value: Column, fn) -> Column:
    """fn of the value, which is worked out once instead of wherever fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """The span without white space at its ends, as struct<start,end>."""

    def cut(part: Column) -> Column:
        lead, tail = F.length(F.regexp_extract(part, r"(?U)\A\s+", 0)), F.length(F.regexp_extract(part, r"(?U)\s+\z", 0))
        first = F.least(start + lead, end)
        return F.struct(first.alias("start"), F.greatest(end - tail, first).alias("end"))

    return let(piece(text, start, end), cut)


def without_edges(text: Column, start: Column, end: Column, words: list[str], signs: str) -> Column:
    """The span without white space, tokens and signs at its ends that say nothing.

    Tokens go that are among words once signs are off, in any letter case; then signs stuck to the first and last one.
    """
    some = "|".join(f"\\Q{w}\\E" for w in sorted(words, key=lambda w: (-len(w), w)))
    token = f"[{signs}]*(?:{some})?[{signs}]*"
    behind = rf"(?iuU)(?:(?:\A|(?<=\s)){token}(?=\s|\z)\s*)+\z"
    ahead = rf"(?iuU)\A\s*(?:{token}(?:\s+|\z))+"

    def tail_off(part: Column) -> Column:
        return F.regexp_replace(F.substring(part, F.lit(1), F.length(part) - F.length(F.regexp_extract(part, behind, 0))), rf"(?U)[\s{GLUED}]+\z", "")

    def head_off(part: Column) -> Column:
        def cut(skip: Column) -> Column:
            more = F.length(F.regexp_extract(F.substring(part, skip + 1, F.length(part)), rf"\A[{GLUED}]+", 0))
            first = F.least(start + skip + more, start + F.length(part))
            return F.struct(first.alias("start"), (start + F.length(part)).alias("end"))

        return let(F.length(F.regexp_extract(part, ahead, 0)), cut)

    # nothing goes where the first and the last token have a digit, as no word does, and no sign is at an end
    far = rf"[\s{GLUED}{signs}]"
    stays = rf"(?sU)\A(?!{far})(?=\S*\p{{Nd}})(?:.*\s)?\S*\p{{Nd}}\S*(?<!{far})\z"
    if any(c.isdecimal() for w in words for c in w):
        return let(let(piece(text, start, end), tail_off), head_off)
    whole = F.struct(start.alias("start"), end.alias("end"))
    return let(piece(text, start, end), lambda p: F.when(p.rlike(stays), whole).otherwise(let(let(p, tail_off), head_off)))
