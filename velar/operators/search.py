"""Literal term search, and the context, values and clipping of spreadsheet cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velar.operators.terms import hits

MOST_TERMS = 100


def term_hits(blocks: DataFrame, terms: Iterable[str] | DataFrame, keys: list[str], text_col: str = "text", most: int | None = MOST_TERMS) -> DataFrame:
    """(keys, term, start, end): every place of each literal term, in any letter case, inside words as well.

    Terms are trimmed; of a list the first `most` different ones count, None for all; of a table (`term`) all count.
    Overlapping places of one term count once. All terms are looked for in one pass (operators.terms).
    """
    if not isinstance(terms, DataFrame):
        terms = list(dict.fromkeys(t.strip() for t in terms if t and t.strip()))[:most]
    return hits(blocks, terms, keys, text_col)


def with_cell_context(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """cells (sheet keys, row, col, value, is_formula) with `text` and the value's place value_start, value_end in it.

    The text is "<context>: <value>". The context is the column's first-row value below row 1, unless a formula; else
    the value of the cell just to the left. A context equal to the value is left out.
    """
    heads = cells.where("row = 1 and not is_formula").select(*sheet, "col", F.col("value").alias("_head"))
    left = Window.partitionBy(*sheet, "row").orderBy("col")
    near = cells.withColumn("_left", F.when(F.lag("col").over(left) == F.col("col") - 1, F.lag("value").over(left)))
    joined = near.join(heads, [*sheet, "col"], "left")
    label = F.coalesce(F.when(F.col("row") > 1, F.col("_head")), F.col("_left"))
    label = F.when(label != F.col("value"), label)
    text = F.when(label.isNotNull(), F.concat(label, F.lit(": "), F.col("value"))).otherwise(F.col("value"))
    done = joined.withColumn("text", text).withColumn("value_end", F.length("text"))
    return done.withColumn("value_start", F.col("value_end") - F.length("value")).drop("_head", "_left")


def clipped(spans: Column, value_start: Column, value_end: Column) -> Column:
    """Spans of a cell's text cut to its value, which the context in front of it is no part of; empty ones go."""
    cut = F.transform(spans, lambda s: s.withField("start", F.greatest(s["start"], value_start)).withField("end", F.least(s["end"], value_end)))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def visible_value(kind: Column, value: Column, number_format: Column) -> Column:
    """What a cell shows: value is its text, a number, or for kind 'date' a timestamp in ISO form.

    Dates are day first, with a time if it isn't midnight; kind 'time' is a time alone. A whole number with a format of
    nothing but zeros is padded to as many digits. Everything else shows as it is.
    """
    at = F.try_to_timestamp(value)
    midnight = F.date_format(at, "HHmmss") == "000000"
    date = F.when(midnight, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "dd/MM/yyyy HH:mm:ss"))
    whole = F.regexp_replace(value, r"\.0+$", "")
    padded = F.lpad(whole, F.greatest(F.length(number_format), F.length(whole)), F.lit("0"))
    zeros = number_format.rlike("^0+$") & whole.rlike("^[0-9]+$")
    return (
        F.when((kind == "date") & at.isNotNull(), date)
        .when((kind == "time") & at.isNotNull(), F.date_format(at, "HH:mm:ss"))
        .when((kind == "number") & zeros, padded)
        .when((kind == "number") & whole.rlike("^-?[0-9]+$"), whole)
        .otherwise(value)
    )
