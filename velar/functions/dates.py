"""Dates moved by a number of days in their own format, and ages turned into five-year bands. Null: cannot be read.

A text is cut into tokens, and each token gets a sign for its kind: d for one or two digits, c for three, y for four, m
for a month's name, o for an ordinal ending, <word> for another word, one space for white space, itself for any other
character. The signs in order are the text's shape, and the shape alone says how to read it: "5 de marzo de 2024" is
"d <de> m <de> y".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velar.functions.spans import let

#: Month names, the two-digit year that ends the 2000s, and the open band.
ES_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
EN_MONTHS = "January February March April May June July August September October November December".split()
PIVOT, OPEN_AGE = 49, 85
ORDINALS = ["st", "nd", "rd", "th"]
MONTH_NUMBER = {
    "es": {m: i + 1 for i, m in enumerate(ES_MONTHS)} | {"setiembre": 9},
    "en": {m.lower()[:n]: i + 1 for i, m in enumerate(EN_MONTHS) for n in (len(m), 3)} | {"sept": 9},
}
#: Shapes, as expressions over the signs. A month with a year counts as its 15th.
NUMBERS, ISO = r"d([-/.])d\1[dy]", "y-d-d"
ES_DAY, ES_MONTH = "d <de> m (<del?> )?y", "m (<del?> )?y"
EN_MONTH_DAY, EN_DAY_MONTH, EN_MONTH = r"m\.? do?,? y", r"do? (<of> )?m\.?,? y", r"m\.? y"
ES_YEARS_OLD, ES_MONTHS_OLD = "[dc] <años>( <de> <edad>)?", "d <meses>( <de> <edad>)?"
EN_YEARS_OLD, EN_MONTHS_OLD = "(<aged> )?[dc][- ]?<years?>([- ]<old>)?|<aged> [dc]", "d[- ]?<months?>([- ]<old>)?"


def _is(shape: Column, pattern: str) -> Column:
    return shape.rlike(f"^(?:{pattern})$")


def _month_number(word: Column, english: Column) -> Column:
    tables = {k: F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for k, t in MONTH_NUMBER.items()}
    return F.when(english, F.try_element_at(tables["en"], F.lower(word))).otherwise(F.try_element_at(tables["es"], F.lower(word)))


def _read(text: Column, english: Column) -> Column:
    """struct<shape, numbers, month, sep>: the shape, the numbers as text, the month's name, the first sign between numbers."""
    tokens = F.regexp_extract_all(F.trim(text), F.lit(r"(?U)\d+|\p{L}+|\s+|[^\d\p{L}\s]"), F.lit(0))

    def sign(t: Column) -> Column:
        size, word = F.length(t), F.lower(t)
        digits = F.when(size <= 2, "d").when(size == 3, "c").when(size == 4, "y").otherwise("#")
        letters = F.when(_month_number(t, english).isNotNull(), "m").when(word.isin(ORDINALS), "o").otherwise(F.concat(F.lit("<"), word, F.lit(">")))
        return F.when(t.rlike("^[0-9]"), digits).when(t.rlike(r"^\p{L}"), letters).when(F.trim(t) == "", " ").otherwise(t)

    months = F.filter(tokens, lambda t: _month_number(t, english).isNotNull())
    return F.struct(
        F.array_join(F.transform(tokens, sign), "").alias("shape"),
        F.filter(tokens, lambda t: t.rlike("^[0-9]+$")).alias("numbers"),
        F.get(months, F.lit(0)).alias("month"),
        F.get(F.filter(tokens, lambda t: t.isin("/", "-", ".")), F.lit(0)).alias("sep"),
    )


def _int(value: Column) -> Column:
    return value.try_cast("int")


def _number(read: Column, i: int) -> Column:
    return _int(F.get(read["numbers"], F.lit(i)))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is none such."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _moved(date: Column, days: Column, write) -> Column:
    """write(the date `days` later); null beyond the years 1 to 9999."""
    return let(F.date_add(date, days.cast("int")), lambda d: F.when(F.year(d).between(1, 9999), write(d)))


def _numeric(read: Column, days: Column, english: Column) -> Column:
    """Two numbers and a year: of the possible orders of day and month exactly one must give a month. Spanish has one order."""
    orders = F.array(
        F.struct(_number(read, 0).alias("day"), _number(read, 1).alias("month"), F.lit(True).alias("day_first")),
        F.struct(_number(read, 1).alias("day"), _number(read, 0).alias("month"), F.lit(False).alias("day_first")),
    )
    possible = F.filter(orders, lambda x: x["month"].between(1, 12) & (x["day_first"] | english))
    year_text = F.get(read["numbers"], F.lit(2))
    short = F.length(year_text) == 2
    year = F.when(~short, _int(year_text)).otherwise(_int(year_text) + F.when(_int(year_text) <= PIVOT, 2000).otherwise(1900))

    def write(d: Column, order: Column) -> Column:
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        day, month, shown = two(F.dayofmonth(d)), two(F.month(d)), F.lpad(F.year(d).cast("string"), 4, "0")
        parts = [F.when(order, day).otherwise(month), F.when(order, month).otherwise(day), F.when(short, F.substring(shown, 3, 2)).otherwise(shown)]
        return F.concat(parts[0], read["sep"], parts[1], read["sep"], parts[2])

    only = F.when((F.size(possible) == 1) & F.length(year_text).isin(2, 4), F.get(possible, F.lit(0)))
    return let(only, lambda x: _moved(_date(year, x["month"], x["day"]), days, lambda d: write(d, x["day_first"])))


def shift_date(text: Column, days: Column, language: Column) -> Column:
    """The date `days` later as it was written: numbers, ISO, or words in the language 'en' or Spanish.

    English numbers count only if just one order of day and month is possible. Beyond year 9999: null.
    """
    english = language == "en"

    def words(read: Column, day: Column, year: int, write) -> Column:
        return _moved(_date(_number(read, year), _month_number(read["month"], english), day), days, write)

    def es_month(d: Column) -> Column:
        return F.get(F.array(*[F.lit(m) for m in ES_MONTHS]), F.month(d) - 1)

    def en_month(d: Column, as_written: Column) -> Column:
        name = F.get(F.array(*[F.lit(m) for m in EN_MONTHS]), F.month(d) - 1)
        return F.when(F.lower(as_written).isin([m.lower() for m in EN_MONTHS]), name).otherwise(F.substring(name, 1, 3))

    def whole(read: Column) -> Column:
        shape, mid = read["shape"], F.lit(15)
        day, year = (lambda d: F.dayofmonth(d).cast("string")), (lambda d: F.year(d).cast("string"))
        iso = F.when(F.length(F.trim(text)) == 10, _date(_number(read, 0), _number(read, 1), _number(read, 2)))
        spanish = (
            F.when(_is(shape, ES_DAY), words(read, _number(read, 0), 1, lambda d: F.concat_ws(" de ", day(d), es_month(d), year(d))))
            .when(_is(shape, ES_MONTH), words(read, mid, 0, lambda d: F.concat_ws(" de ", es_month(d), year(d))))
        )
        name = lambda d: en_month(d, read["month"])
        in_english = (
            F.when(_is(shape, EN_MONTH_DAY), words(read, _number(read, 0), 1, lambda d: F.concat(name(d), F.lit(" "), day(d), F.lit(", "), year(d))))
            .when(_is(shape, EN_DAY_MONTH), words(read, _number(read, 0), 1, lambda d: F.concat_ws(" ", day(d), name(d), year(d))))
            .when(_is(shape, EN_MONTH), words(read, mid, 0, lambda d: F.concat_ws(" ", name(d), year(d))))
        )
        return (
            F.when(_is(shape, ISO), _moved(iso, days, lambda d: F.date_format(d, "yyyy-MM-dd")))
            .when(_is(shape, NUMBERS), _numeric(read, days, english))
            .otherwise(F.when(english, in_english).otherwise(spanish))
        )

    return let(_read(text, english), whole)


def is_age(text: Column, language: Column) -> Column:
    """Whether the text is an age in years or months, and nothing else."""
    english = language == "en"
    en, es = f"{EN_YEARS_OLD}|{EN_MONTHS_OLD}", f"{ES_YEARS_OLD}|{ES_MONTHS_OLD}"
    return let(_read(text, english), lambda r: F.when(english, _is(r["shape"], en)).otherwise(_is(r["shape"], es)))


def age_band(text: Column, language: Column) -> Column:
    """The five-year band of an age, in its language; under a year and from the open band on by name; else null."""
    english = language == "en"

    def band(read: Column) -> Column:
        n, shape = _number(read, 0), read["shape"]
        in_months = F.when(english, _is(shape, EN_MONTHS_OLD)).otherwise(_is(shape, ES_MONTHS_OLD))
        in_years = F.when(english, _is(shape, EN_YEARS_OLD)).otherwise(_is(shape, ES_YEARS_OLD))
        age = F.when(in_months, F.floor(n / 12)).otherwise(n)
        low = (F.floor(age / 5) * 5).cast("int")
        five = F.concat_ws("-", low.cast("string"), (low + 4).cast("string"))
        baby, old = in_months & (n < 12), age >= OPEN_AGE
        es = F.when(baby, "menor de 1 año").when(old, f"{OPEN_AGE} o más años").otherwise(F.concat(five, F.lit(" años")))
        en = F.when(baby, "under 1 year").when(old, f"{OPEN_AGE} or older").otherwise(F.concat(five, F.lit(" years")))
        tail = F.when(F.contains(shape, F.lit("<edad>")), " de edad").otherwise("")
        return F.when(in_months | in_years, F.when(english, en).otherwise(F.concat(es, tail)))

    return let(_read(text, english), band)


def shift_days(doc: Column, secret: str, least: int = 30, most: int = 180) -> Column:
    """A document's shift: least to most days, forth or back, the same for the same secret.

    The number comes from SHA-256 keyed with the secret, twice, so that it can't be worked out from the id alone.
    """
    if not secret:
        raise ValueError("a secret is needed")
    key = F.lit(secret)
    digest = F.sha2(F.concat(key, F.sha2(F.concat(key, F.lit("\n"), doc.cast("string")), 256)).cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    back = F.conv(F.substring(digest, 13, 1), 16, 10).cast("int") % 2 == 1
    return (number % (most - least + 1) + least).cast("int") * F.when(back, -1).otherwise(1)
