"""Which detection language a text has: Spanish or English, by function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words counted for each language, most tokens looked at, what an accent adds, and the ratio to win by.
ES_WORDS = "el la los las un una unos unas de del y que en con por para su sus se al lo como más pero le ya o este esta son es está días años según sobre entre hasta desde cuando paciente señor señora doña fecha nombre domicilio".split()
EN_WORDS = "the a an of and to in is are was were for with on at by from this that these those it as be has have had not but or which who shall will patient name date address hereby between".split()
MOST_TOKENS, ACCENT_BONUS, RATIO = 4000, 3, 1.15


def latin_words(text: Column) -> Column:
    """The runs of Latin letters of the lower-cased text, Spanish ones included, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúñü]+"), F.lit(0))


def language_of(words: Column, text: Column, most: int | None = MOST_TOKENS) -> Column:
    """'en' if English words outnumber Spanish ones by the ratio among the first `most` words (None: all), else 'es'.

    An accented small letter or an inverted mark anywhere in the text counts for Spanish. Null or empty: 'es'.
    """
    tokens = F.slice(words, 1, most) if most else words
    count = lambda known: F.size(F.filter(tokens, lambda t: t.isin(known)))
    bonus = F.when(text.rlike("[áéíóúñ¿¡]"), ACCENT_BONUS).otherwise(0)
    return F.when(text.isNotNull() & (count(EN_WORDS) > (count(ES_WORDS) + bonus) * F.lit(RATIO)), "en").otherwise("es")


def detection_language(text: Column, most: int | None = MOST_TOKENS) -> Column:
    """language_of the text's own words."""
    return language_of(latin_words(text), text, most)


def document_language(blocks: DataFrame, doc: str = "doc_id", block: str = "block_id", text: str = "text", first: int | None = 60) -> DataFrame:
    """(doc, language): by the first blocks of each document in order (None: by all), joined by a space."""
    early = blocks.select(doc, block, text)
    if first:
        place = F.row_number().over(Window.partitionBy(doc).orderBy(block))
        early = early.withColumn("_place", place).where(F.col("_place") <= first)
    parts = early.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col(text).alias("t")))).alias("parts"))
    sample = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    return parts.select(doc, detection_language(sample).alias("language"))
