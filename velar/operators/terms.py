"""Literal terms as a table: every place of each of many terms, in one pass over the texts, however many there are.

The terms of a block of at most BLOCK_BYTES go to all tasks as an Aho-Corasick automaton, which reads a text once. More
terms make more blocks, which are looked for one after another; what was found so far is written in between, so that a
task and the driver hold one block at a time. Characters are folded one by one, so that places stay places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velar.sources.tables import scratch, written

BLOCK_BYTES = 16 << 20
PLACES = "array<struct<term:string,start:int,end:int>>"


class _Folds(dict):
    """What a character is folded to: the small form of its capital form, if both are one character."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        high = c.upper() if len(c.upper()) == 1 else c
        low = high.lower() if len(high.lower()) == 1 else c
        self[code] = ord(low)
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text with letter case taken away; as long as before."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """Finds the places of terms in texts."""

    def __init__(self, terms: Iterable[str]):
        import ahocorasick

        spellings: dict[str, list[str]] = {}
        for t in terms:
            spellings.setdefault(folded(t), []).append(t)
        self.found = ahocorasick.Automaton()
        for key, same in spellings.items():
            self.found.add_word(key, (len(key), same))
        self.found.make_automaton()
        self.any = bool(spellings)

    def places(self, text: str, whole: bool = False, all_: bool = False) -> list[tuple[str, int, int]]:
        """(term, start, end) by end: those that overlap an earlier place of the same term don't count, unless all_.

        whole: only places with no letter, digit or underscore just before or after.
        """
        if not self.any or not text:
            return []
        out, free = [], {}
        for at, (size, same) in self.found.iter(folded(text)):
            start, end = at + 1 - size, at + 1
            if whole and (start and is_word(text[start - 1]) or end < len(text) and is_word(text[end])):
                continue
            if all_ or start >= free.get(same[0], 0):
                free[same[0]] = end
                out += [(t, start, end) for t in same]
        return out


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, held: Broadcast) -> Automaton:
    """The automaton of a block of terms: a worker builds it once for all its batches and tasks, and holds two at most."""
    if name not in _BUILT:
        if len(_BUILT) > 1:
            _BUILT.clear()
        _BUILT[name] = Automaton(held.value)
    return _BUILT[name]


def _finder(held: Broadcast, whole: bool, all_: bool):
    name = uuid.uuid4().hex

    @F.pandas_udf(PLACES)
    def find(text):
        import pandas as pd

        search = _automaton(name, held)
        return pd.Series([[{"term": a, "start": b, "end": c} for a, b, c in search.places(t, whole, all_)] if t else [] for t in text])

    return find


def distinct_terms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term): the different terms without outer white space; null and blank ones are left out."""
    bare = F.regexp_replace(F.col(term_col).cast("string"), r"(?U)\A\s+|\s+\z", "")
    return terms.select(bare.alias("term")).where("term != ''").distinct()


def _blocks(terms: DataFrame | Iterable[str], term_col: str, block_bytes: int) -> Iterator[list[str]]:
    if not isinstance(terms, DataFrame):
        yield sorted({t.strip() for t in terms if t and t.strip()})
        return
    chosen = distinct_terms(terms, term_col)
    total = chosen.agg(F.sum(F.octet_length("term")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:
        path = scratch(terms.sparkSession)
        chosen.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n))).write.partitionBy("block").parquet(path)
        chosen = terms.sparkSession.read.parquet(path)
    for k in range(n):
        part = chosen.where(F.col("block") == k).select("term") if n > 1 else chosen
        yield sorted(t["term"] for t in part.collect())  # block_bytes, as far as hashes deal evenly


def with_places(
    blocks: DataFrame, terms: DataFrame | Iterable[str], out: str, text_col: str = "text", term_col: str = "term", whole: bool = False, overlapping: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """blocks with a column `out`, array<struct<term,start,end>>: every place of each term, in any letter case.

    terms is a table with a column of terms, or a list. Terms are trimmed; repeated, blank and null ones count for
    nothing; terms that differ in letter case only are all named at their places. Places inside words count unless
    `whole`. Places of one term that overlap an earlier one count only if `overlapping`. Null and empty texts have none.
    Rows that repeat each keep theirs; very long texts are read whole; an empty table gives an empty result.
    """
    spark, found = blocks.sparkSession, blocks
    for k, part in enumerate(_blocks(terms, term_col, block_bytes)):
        held = spark.sparkContext.broadcast(part)
        places = _finder(held, whole, overlapping)(F.col(text_col))
        found = found.withColumn(out, places) if k == 0 else written(found).withColumn(out, F.concat(F.col(out), places))
    return found.withColumn(out, F.array_sort(F.col(out), lambda a, b: _by_place(a, b)))


def _by_place(a, b):
    keys = [(a[k], b[k]) for k in ("start", "end", "term")]
    out = F.lit(0)
    for x, y in reversed(keys):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def hits(blocks: DataFrame, terms: DataFrame | Iterable[str], keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """(keys, term, start, end): one row for each place that with_places() finds."""
    narrow = blocks.select(*dict.fromkeys([*keys, text_col]))
    each = with_places(narrow, terms, "_places", text_col, **options).select(*keys, F.explode("_places").alias("p"))
    return each.select(*keys, "p.term", "p.start", "p.end")


def own_hits(blocks: DataFrame, terms: DataFrame, doc: str, keys: list[str], text_col: str = "text", term_col: str = "term", whole: bool = False) -> DataFrame:
    """(keys, term, start, end): places of the terms (doc, term) in their own document's blocks only.

    All documents' different terms are looked for in one pass, and places of other documents' terms go by a semi join on
    (doc, term), which a document with very many places doesn't hold up: its rows are split as any join's.
    """
    table = terms.select(F.col(doc).alias("_doc"), F.regexp_replace(F.col(term_col).cast("string"), r"(?U)\A\s+|\s+\z", "").alias("_term")).where("_term != ''").distinct()
    found = hits(blocks, table, list(dict.fromkeys([*keys, doc])), text_col, term_col="_term", whole=whole, overlapping=False)
    return found.join(table, (F.col(doc) == F.col("_doc")) & (F.col("term") == F.col("_term")), "left_semi").select(*keys, "term", "start", "end")
