"""Format and checksum tests of identifiers: Column -> boolean Column, built-in expressions only.

Separators are dropped first and letters compared in upper case. A null value gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control letters by remainder, control letters of company numbers, and what is never issued.
ID_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
NINO_FIRST, NINO_SECOND = "DFIQUV", "DFIOQUV"
NINO_PREFIXES = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]
ITIN_GROUPS = [(50, 65), (70, 88), (90, 92), (94, 99)]


def _bare(value: Column, separators: str) -> Column:
    return F.upper(F.regexp_replace(value, f"(?U)[{separators}]", ""))


def _full(value: Column, pattern: str) -> Column:
    """Whether the whole value matches. `\\z`, as `$` would let a line end pass."""
    return value.rlike(rf"\A(?:{pattern})\z")


def _digit(value: Column, i: int) -> Column:
    """The i-th character (from 0) as a number; only read where a format test has passed."""
    return F.substring(value, i + 1, 1).try_cast("int")


def _number(value: Column, start: int, size: int) -> Column:
    return F.substring(value, start + 1, size).try_cast("bigint")


def _if(shape: Column, test: Column) -> Column:
    """The test where the shape holds, else false: nothing is computed on values of another shape."""
    return F.when(shape, F.coalesce(test, F.lit(False))).when(shape.isNull(), None).otherwise(False)


def _letter_of(number: Column) -> Column:
    return F.substring(F.lit(ID_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def national_id(value: Column) -> Column:
    """Eight digits and the letter of their remainder by 23."""
    v = _bare(value, r"\s.\-")
    return _if(_full(v, r"\d{8}[A-Z]"), _letter_of(_number(v, 0, 8)) == F.substring(v, 9, 1))


def foreigner_id(value: Column) -> Column:
    """X, Y or Z for 0, 1 or 2, seven digits, and the letter as for a national id."""
    v = _bare(value, r"\s.\-")
    number = F.translate(F.substring(v, 1, 8), "XYZ", "012").try_cast("bigint")
    return _if(_full(v, r"[XYZ]\d{7}[A-Z]"), _letter_of(number) == F.substring(v, 9, 1))


def es_social_security(value: Column) -> Column:
    """Province, serial and remainder by 97; a serial from ten million on is joined to the province as text."""
    v = _bare(value, r"\s./\-")
    padded = F.lpad(v, 12, "0")
    province, serial, control = _number(padded, 0, 2), _number(padded, 2, 8), _number(padded, 10, 2)
    joined = F.concat(province.cast("string"), serial.cast("string")).try_cast("bigint")
    base = F.when(serial < 10_000_000, province * 10_000_000 + serial).otherwise(joined)
    return _if(_full(v, r"\d{11,12}"), base % 97 == control)


def es_phone(value: Column) -> Column:
    v = F.regexp_replace(_bare(value, r"\s.\-()"), r"\A\+34", "")
    return _full(F.regexp_replace(v, r"\A0034", ""), r"[6789]\d{8}")


def es_postcode(value: Column) -> Column:
    v = F.trim(value)
    return _if(_full(v, r"\d{5}"), _number(v, 0, 2).between(1, 52))


def iban(value: Column) -> Column:
    """Country and control moved to the end, letters as 10 to 35, remainder by 97 is 1; folded digit by digit."""
    v = _bare(value, r"\s\-")
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    values = F.transform(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), lambda c: F.conv(c, 36, 10).try_cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda rest, n: (rest * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return _if(_full(v, r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}"), rest == 1)


def es_company_id(value: Column) -> Column:
    """Class letter, seven digits, control by doubled odd places; as a letter, a digit or either, by class."""
    v = _bare(value, r"\s.\-")
    even = sum(_digit(v, i) for i in (2, 4, 6))
    doubled = [_digit(v, i) * 2 for i in (1, 3, 5, 7)]
    odd = sum(F.floor(d / 10) + d % 10 for d in doubled)
    control = ((10 - (even + odd) % 10) % 10).cast("int")
    given, first = F.substring(v, 9, 1), F.substring(v, 1, 1)
    as_digit, as_letter = given == control.cast("string"), given == F.substring(F.lit(COMPANY_LETTERS), control + 1, F.lit(1))
    test = F.when(first.isin(*"PQRSNW"), as_letter).when(first.isin(*"ABEH"), as_digit).otherwise(as_digit | as_letter)
    return _if(_full(v, r"[ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J]"), test)


def payment_card(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    return _if(_full(v, r"\d{13,19}"), F.call_function("luhn_check", v))


def es_plate(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    return _full(v, r"\d{4}[BCDFGHJKLMNPRSTVWXYZ]{3}|[A-Z]{1,2}\d{4}[A-Z]{1,2}")


def land_registry(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    return _full(v, r"[A-Z0-9]{20}") & v.rlike("[A-Z]") & v.rlike("[0-9]")


def es_passport(value: Column) -> Column:
    return _full(_bare(value, r"\s\-"), r"[A-Z]{2,3}\d{6}")


def uk_nhs(value: Column) -> Column:
    """Ten digits; weights ten down to two; eleven less the remainder by eleven, where ten is never issued."""
    v = _bare(value, r"\s\-")
    control = 11 - sum(_digit(v, i) * (10 - i) for i in range(9)) % 11
    return _if(_full(v, r"\d{10}"), (control != 10) & (F.when(control == 11, 0).otherwise(control) == _digit(v, 9)))


def uk_nino(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    letters = F.substring(v, 1, 2)
    return _full(v, rf"[A-Z&&[^{NINO_FIRST}]][A-Z&&[^{NINO_SECOND}]]\d{{6}}[A-D]") & ~letters.isin(NINO_PREFIXES)


def us_ssn(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    area, group, serial = _number(v, 0, 3), _number(v, 3, 2), _number(v, 5, 4)
    return _if(_full(v, r"\d{9}"), (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0))


def us_itin(value: Column) -> Column:
    v = _bare(value, r"\s\-")
    group, inside = _number(v, 3, 2), F.lit(False)
    for low, high in ITIN_GROUPS:
        inside = inside | group.between(low, high)
    return _if(_full(v, r"9\d{8}"), inside)


def uk_postcode(value: Column) -> Column:
    return _full(F.upper(F.trim(value)), r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}")


def us_zip(value: Column) -> Column:
    return _full(F.trim(value), r"\d{5}(?:-\d{4})?")


def uk_phone(value: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(_bare(value, r"\s.\-()"), r"\A\+44", ""), r"\A0044", "")
    return _full(F.when(v.startswith("0"), v).otherwise(F.concat(F.lit("0"), v)), r"0\d{9,10}")


def us_phone(value: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(_bare(value, r"\s.\-()"), r"\A\+1", ""), r"\A001", "")
    return _full(v, r"[2-9]\d{2}[2-9]\d{6}")


CHECKS = {
    f.__name__: f
    for f in (
        national_id, foreigner_id, es_social_security, es_phone, es_postcode, iban, es_company_id, payment_card, es_plate, land_registry,
        es_passport, uk_nhs, uk_nino, us_ssn, us_itin, uk_postcode, us_zip, uk_phone, us_phone,
    )
}
