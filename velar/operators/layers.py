"""Proposals of a language model as spans: replies are parsed, their fragments found word for word in the texts.

A reply is free text around a JSON object {"entidades": [{"texto": ..., "tipo": ...}]}. How replies are got is no matter
of this module: they come as a table, one row for each block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velar.operators.detect import EMPTY, SPAN, known_categories, plain

#: Kinds of fragment in replies and their categories, the score of a proposal, its shortest text.
KINDS = {
    "persona": "person", "paciente": "person", "familiar": "person", "sanitario": "clinician", "profesional": "clinician", "medico": "clinician",
    "centro": "health_centre", "hospital": "health_centre", "servicio": "department", "direccion": "address", "localidad": "place_or_postcode",
    "lugar": "place_or_postcode", "telefono": "phone", "email": "email", "fecha": "date",
}
LAYER, SCORE, SHORTEST = 3, 0.5, 3
FRAGMENTS = "array<struct<fragment:string,kind:string>>"


def _objects(text: str):
    """Every value that a JSON object at a brace of the text gives, first brace first, whatever stands behind it."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            yield decoder.raw_decode(text, at)[0]
        except ValueError:
            pass
        at = text.find("{", at + 1)


def fragments_of(reply: str | None) -> list[dict]:
    """(fragment, kind) of a reply; what a model thinks aloud and fences of code are left out first. None: nothing."""
    bare = re.sub(r"(?is)<think>.*?</think>", "", reply or "")
    bare = re.sub(r"```(?:json)?", "", bare)
    found = next(_objects(bare), {})
    items = found.get("entidades", []) if isinstance(found, dict) else []
    out = []
    for item in items if isinstance(items, list) else []:
        if isinstance(item, dict):
            out.append({"fragment": str(item.get("texto", "")).strip(), "kind": str(item.get("tipo", "")).strip().lower()})
    return out


def parsed(reply: Column) -> Column:
    """FRAGMENTS of each reply; braces that balance are beyond a regular expression."""

    @F.pandas_udf(FRAGMENTS)
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(fragments_of)

    return run(reply)


def _places(text: Column, fragment: Column) -> Column:
    """array<int>: where a fragment begins in a text, in any letter case, with no letter or digit beside its own.

    Places go from left to right; the next is looked for behind the last one taken.
    """
    low, part = F.lower(text), F.lower(fragment)
    word = lambda c: F.coalesce(c.rlike(r"(?U)^[\p{L}\p{N}_]$"), F.lit(False))
    size = F.length(part)
    gaps = F.split(low, F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    starts = F.aggregate(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, g: F.struct((acc["at"] + F.length(g) + size).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(g)).alias("out")),
        lambda acc: acc["out"],
    )
    first, last = word(F.substring(part, 1, 1)), word(F.substring(part, -1, 1))

    def free(at: Column) -> Column:
        left = (at == 0) | ~word(F.substring(text, at, F.lit(1))) | ~first
        right = ~word(F.substring(text, at + size + 1, F.lit(1))) | ~last
        return left & right

    return F.filter(starts, free)


def proposed(blocks: DataFrame, replies: DataFrame, keys: list[str], categories: Iterable[str] | None = None, text_col: str = "text") -> DataFrame:
    """blocks with `proposed`, array<SPAN> of layer 3: every place of the fragments of their replies (keys, reply).

    Fragments of under three characters, of unknown kinds, or of categories not asked for are left out, as are those
    that the text doesn't hold. A block without a reply has none. Several replies to a block count together.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    chosen = known_categories(categories)
    each = replies.select(*keys, F.explode(parsed(F.col("reply"))).alias("f")).select(*keys, "f.fragment", F.try_element_at(kinds, F.col("f.kind")).alias("category"))
    wanted = each.where((F.length("fragment") >= SHORTEST) & F.col("category").isin(chosen)).groupBy(*keys).agg(F.collect_set(F.struct("fragment", "category")).alias("_wanted"))
    text = plain(F.col(text_col))

    def of(w: Column) -> Column:
        end = lambda at: at + F.length(w["fragment"])
        made = lambda at: F.struct(at.alias("start"), end(at).alias("end"), w["category"].alias("category"), F.lit(LAYER).alias("layer"), F.lit(SCORE).alias("score"), F.lit("llm").alias("detector"))
        return F.transform(_places(text, w["fragment"]), made)

    found = F.flatten(F.transform("_wanted", of)).cast(f"array<{SPAN}>")
    return blocks.join(wanted, keys, "left").withColumn("proposed", F.coalesce(found, F.array().cast(EMPTY))).drop("_wanted")


