import datetime as dt

import pytest
from pyspark.sql import functions as F

from velar.functions import checks, dates, language, spans

GOOD = {
    "national_id": ["47301928J", "47.301.928-J", "00000000t"],
    "foreigner_id": ["X0000000T", "Y-0000001-S"],
    "es_social_security": ["418320511792"],
    "es_phone": ["+34 612 345 678", "0034912345678", "912345678"],
    "es_postcode": ["01001", "52999"],
    "iban": ["ES66 2100 0731 6203 0045 8817", "GB15VELR30491277310064", "MT84VELR31004000045120TEST07X"],
    "es_company_id": ["A41730268", "B-7720513-6", "Q3128004C"],
    "payment_card": ["4000 1234 5678 9017", "5300-1724-0000-5610"],
    "es_plate": ["1234 BCD", "M-1234-AB"],
    "land_registry": ["4417032CS8841N0003QK"],
    "es_passport": ["AAA123456", "ab 123456"],
    "uk_nhs": ["481 230 9751", "7319045621"],
    "uk_nino": ["CE 47 30 19 B"],
    "us_ssn": ["412-38-4417"],
    "us_itin": ["912-70-1234", "900-50-0000", "900-99-0000"],
    "uk_postcode": ["sw1a 1aa", "M11AE"],
    "us_zip": ["12345", "12345-6789"],
    "uk_phone": ["+44 20 7946 0958", "020 7946 0958"],
    "us_phone": ["+1 (312) 555-0147", "3125550147"],
}
BAD = {
    "national_id": ["47301928A", "4730192J", ""],
    "foreigner_id": ["X0000000A", "W0000000T"],
    "es_social_security": ["418320511793", "4183205117"],
    "es_phone": ["512345678", "61234567"],
    "es_postcode": ["00999", "53000", "1234"],
    "iban": ["ES6621000731620300458818", "ES66"],
    "es_company_id": ["A41730269", "Q31280043", "I41730268"],
    "payment_card": ["4000123456789018", "400012345678"],
    "es_plate": ["1234 ABE", "ABC-1234-A"],
    "land_registry": ["44170328841000300000", "4417032CS8841N0003Q"],
    "es_passport": ["A123456", "AAA12345"],
    "uk_nhs": ["4812309752", "481230975"],
    "uk_nino": ["DA123456C", "AO123456C", "GB123456A", "AB123456E"],
    "us_ssn": ["000-38-4417", "666-38-4417", "900-38-4417", "412-00-4417", "412-38-0000"],
    "us_itin": ["912-66-1234", "912-93-1234", "812-70-1234"],
    "uk_postcode": ["SW1A1A", "1A 1AA"],
    "us_zip": ["1234", "12345-678"],
    "uk_phone": ["+44 20 79", "12"],
    "us_phone": ["1125550147", "3121550147"],
}


def test_checks(spark):
    assert GOOD.keys() == BAD.keys() == checks.CHECKS.keys()
    rows = [(n, v, w) for w, table in ((True, GOOD), (False, BAD)) for n, vs in table.items() for v in vs]
    df = spark.createDataFrame(rows, "name string, value string, want boolean")
    for name, check in checks.CHECKS.items():
        got = df.where(F.col("name") == name).withColumn("got", check(F.col("value"))).where("got is null or got != want")
        assert got.collect() == [], name
        assert spark.sql("select cast(null as string) v").select(check(F.col("v")).alias("x")).first().x is None


def test_find_all_as_python(spark):
    import re

    rows = [("a😀b 12 345\n6",), ("12",), ("",), (None,), ("x12",), ("ñandú 7", )]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", spans.find_all(F.col("t"), r"\d+").alias("s"), spans.find_all(F.col("t"), r"[a-z ](\d*)", 1).alias("g")).collect()
    for r in got:
        assert [tuple(s) for s in r.s] == [m.span() for m in re.finditer(r"[0-9]+", r.t or "")]
        assert [tuple(s) for s in r.g] == [m.span(1) for m in re.finditer(r"[a-z ]([0-9]*)", r.t or "") if m[1]]


def test_language(spark):
    rows = [("El paciente vive en la calle", "es"), ("The patient was seen by the doctor", "en"), ("", "es"), (None, "es"), ("123", "es"), ("the of ñ", "es"), ("the of and to ñ", "en"), ("THE OF Á", "en")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.withColumn("got", language.detection_language(F.col("t"))).where("got != want").collect() == []


@pytest.mark.parametrize("text,days,lang,want", [
    ("28/02/2024", 2, "es", "01/03/2024"), ("1-2-78", 30, "es", "03-03-78"), ("2024-12-31", 1, "en", "2025-01-01"),
    ("5 de marzo de 2024", -5, "es", "29 de febrero de 2024"), ("Enero del 2024", 30, "es", "febrero de 2024"),
    ("31/02/2024", 1, "es", None), ("03/04/2024", 1, "en", None), ("13/04/2024", 1, "en", "14/04/2024"), ("04/13/24", 20, "en", "05/03/24"),
    ("January 5, 2024", 30, "en", "February 4, 2024"), ("Sept. 3rd 2023", 1, "en", "Sep 4, 2023"), ("5th of March 2024", 1, "en", "6 March 2024"),
    ("Jan 2024", 20, "en", "Feb 2024"), ("31/12/9999", 5, "es", None), ("tomorrow", 1, "en", None), ("5 de foo de 2024", 1, "es", None),
])
def test_shifted_dates(spark, text, days, lang, want):
    df = spark.createDataFrame([(text, days, lang)], "t string, d int, l string")
    assert df.select(dates.shift_date(F.col("t"), F.col("d"), F.col("l")).alias("x")).first().x == want


def test_shift_back_is_identity(spark):
    days = [(dt.date(2000, 1, 1) + dt.timedelta(n)).strftime("%d/%m/%Y") for n in range(0, 9000, 37)]
    df = spark.createDataFrame([(d,) for d in days], "t string")
    es = F.lit("es")
    back = dates.shift_date(dates.shift_date(F.col("t"), F.lit(177), es), F.lit(-177), es)
    assert df.where(~F.col("t").eqNullSafe(back)).count() == 0


def test_age_bands(spark):
    rows = [("47 años", "es", "45-49 años"), ("8 meses de edad", "es", "menor de 1 año de edad"), ("18 meses", "es", "0-4 años"), ("90 años de edad", "es", "85 o más años de edad"), ("47 years old", "en", "45-49 years"), ("aged 86", "en", "85 or older"), ("8 months old", "en", "under 1 year"), ("47-year-old", "en", "45-49 years"), ("1/2/2024", "es", None), ("47 años", "en", None)]
    df = spark.createDataFrame(rows, "t string, l string, want string")
    assert df.withColumn("got", dates.age_band(F.col("t"), F.col("l"))).where("not (got <=> want)").collect() == []
    spread = spark.range(2000).select(dates.shift_days(F.col("id"), "k").alias("d"))
    assert spread.where("abs(d) not between 30 and 180").count() == 0 and spread.where("d < 0").count() > 800
