"""Sample texts with known personal data, made from whole numbers: one text for each key and template.

A template is a sentence around a value, and what a detection of the sentence must give. Values are expressions over
the key k that Spark and other SQL engines read alike, so that the same expression makes the text and the expected row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velar.functions.checks import ID_LETTERS
from velar.sinks.ooxml import packed

PER_KEY = 100  # numbers of texts kept for each key


@dataclass(frozen=True)
class Template:
    """detector, category and score in hundredths of the detection; value: what stands in the sentence at {}; shown: the
    detected text where it is another one; also: further detections; where: a condition for the detection to be there.
    """

    detector: str
    category: str
    score: int
    sentence: str
    value: str
    shown: str = ""
    also: list[tuple[str, str, int, str]] = field(default_factory=list)
    where: str = "true"

    def text(self) -> str:
        before, after = self.sentence.split("{}")
        return f"'{before}' || {self.value} || '{after}'"

    def expected(self) -> list[tuple[str, str, int, str]]:
        return [(self.detector, self.category, self.score, self.shown or self.value), *self.also]


def _pad(number: str, size: int) -> str:
    return f"lpad(CAST({number} AS STRING), {size}, '0')"


def _at(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i}, 1) AS INT)"


def _letter(number: str, table: str = ID_LETTERS) -> str:
    return f"substr('{table}', CAST({number} AS INT) + 1, 1)"


def _capital() -> str:
    return "chr(CAST(65 + k % 26 AS INT))"


def _doubled(digit: str) -> str:
    """Twice a digit, its digits added."""
    return f"({digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"


_CARD = f"'400000' || {_pad('k % 1000000000', 9)}"
_CARD_SUM = " + ".join(_doubled(_at(f"({_CARD})", i)) if i % 2 else _at(f"({_CARD})", i) for i in range(1, 16))
_COMPANY = _pad("k % 10000000", 7)
_COMPANY_SUM = " + ".join(_at(_COMPANY, i) if i % 2 == 0 else _doubled(_at(_COMPANY, i)) for i in range(1, 8))
_NHS = f"'9' || {_pad('k % 100000000', 8)}"
_NHS_CHECK = "(11 - (" + " + ".join(f"{_at(f'({_NHS})', i)} * {11 - i}" for i in range(1, 10)) + ") % 11)"
_DAY = _pad("k % 28 + 1", 2)

SPANISH = [
    Template("national_id", "es_national_id", 100, "documento {} vigente", f"{_pad('k', 8)} || {_letter('k % 23')}"),
    Template("foreigner_id", "es_national_id", 100, "documento {} vigente", f"'X-' || {_pad('k', 7)} || '-' || {_letter('k % 23')}"),
    Template("social_security", "es_social_security", 100, "afiliado {} hoy", f"'28/' || {_pad('k', 8)} || '/' || {_pad('(280000000 + k) % 97', 2)}"),
    Template("phone", "phone", 80, "llamar al {} hoy", f"'6' || {_pad('k % 100000000', 8)}"),
    Template("phone", "phone", 45, "son los {} dados", f"'91 ' || {_pad('k % 10000000', 7)}"),
    Template("email", "email", 85, "escribir a {}, gracias", "'u.' || CAST(k AS STRING) || '@correo.example.org'"),
    Template("iban_digits", "iban", 100, "abonar en {} ya", f"'ES' || {_pad('98 - (k * 1000000 + 142800) % 97', 2)} || {_pad('k', 20)}"),
    Template("iban_letters", "iban", 100, "abonar en {} ya", f"'GB' || {_pad(f'98 - ({10111213 % 97 * pow(10, 22, 97)} + k * 1000000 + 161100) % 97', 2)} || 'ABCD' || {_pad('k', 16)}"),
    Template("card", "payment_card", 100, "pagado con {} ayer", f"{_CARD} || CAST((10 - ({_CARD_SUM}) % 10) % 10 AS STRING)"),
    Template("company_id", "es_company_tax_id", 100, "emisor {} activo", f"'B' || {_COMPANY} || CAST((10 - ({_COMPANY_SUM}) % 10) % 10 AS STRING)"),
    Template("plate", "plate", 85, "un coche {} rojo", f"{_pad('k % 10000', 4)} || ' BCD'"),
    Template("old_plate", "plate", 65, "con matrícula {} vista", f"'M-' || {_pad('k % 10000', 4)} || '-AB'"),
    Template("land_registry", "land_registry", 60, "código {} dado", f"{_pad('k', 7)} || 'VH5797S0001WX'"),
    Template("company", "organisation", 55, "la firma {}. abre", f"{_capital()} || 'ares Norte S.L'"),
    Template("court", "organisation", 60, "ante el {} hoy", "'Juzgado de Instancia nº ' || CAST(k % 90 + 1 AS STRING)"),
    Template("health_card", "es_health_card", 90, "código {} dado", f"'BBBBBBBBAB' || {_pad('k % 1000000', 6)}"),
    Template("health_card_any", "es_health_card", 55, "sanitaria {} dada", f"'XY' || {_pad('k % 1000000', 6)}"),
    Template("date", "date", 60, "visto el {} aquí", f"{_DAY} || '/03/2024'"),
    Template("iso_date", "date", 60, "visto el {} aquí", f"'2024-03-' || {_DAY}"),
    Template("long_date", "date", 75, "visto el {} aquí", "CAST(k % 28 + 1 AS STRING) || ' de marzo de 2024'"),
    Template("month", "date", 50, "desde {} aquí", "'marzo de ' || CAST(1990 + k % 30 AS STRING)"),
    Template("age", "birth_or_age", 50, "tiene {} ya", "CAST(k % 80 + 18 AS STRING) || ' años'"),
    Template("age_months", "birth_or_age", 60, "tiene {} ya", "CAST(k % 11 + 1 AS STRING) || ' meses de edad'", shown="CAST(k % 11 + 1 AS STRING) || ' meses'"),
    Template("island_postcode", "place_or_postcode", 50, "zona {} norte", f"'35' || {_pad('k % 1000', 3)}"),
    Template("postcode", "place_or_postcode", 50, "municipio {} norte", f"'28' || {_pad('k % 1000', 3)}"),
    Template("street", "address", 95, "vive en {}, hoy", "'Calle Mayor ' || CAST(k % 90 + 1 AS STRING)"),
    Template("department", "department", 55, "visto en {}; fin", f"'Servicio de ' || {_capital()} || 'ardiología'"),
    Template("centre", "health_centre", 60, "visto en {}; fin", f"'Hospital de ' || {_capital()} || 'anta'"),
    Template("centre_letters", "health_centre", 70, "visto en {}; fin", "CASE k % 2 WHEN 0 THEN 'HUC' ELSE 'HUNSC' END"),
    Template("regional_service", "health_centre", 75, "visto en {}; fin", "CASE k % 2 WHEN 0 THEN 'Servicio Canario de Salud' ELSE 'Gerencia de Atención Primaria' END"),
    Template("signature", "clinician", 70, "vale {}; fin", f"'Dra. Ana ' || {_capital()} || 'omez'", shown=f"'Ana ' || {_capital()} || 'omez'"),
    Template("sex", "sex", 85, "y {}; fin", "'sexo: ' || CASE k % 2 WHEN 0 THEN 'mujer' ELSE 'hombre' END", shown="CASE k % 2 WHEN 0 THEN 'mujer' ELSE 'hombre' END"),
    Template("sex_phrase", "sex", 50, "una {}; fin", "'mujer de ' || CAST(k % 80 + 18 AS STRING) || ' años'", shown="'mujer'", also=[("age", "birth_or_age", 85, "CAST(k % 80 + 18 AS STRING) || ' años'")]),
    Template("role_name", "person", 85, "Cliente: {}; fin", f"'Ana ' || {_capital()} || 'omez Ruiz'"),
    Template("title_name", "person", 70, "con Don {}; fin", f"'Ana ' || {_capital()} || 'omez'"),
    Template("record", "medical_record", 75, "NHC: {}; fin", _pad("k", 7)),
    Template("episode", "medical_record", 60, "episodio nº {}; fin", "CAST(100000 + k AS STRING)"),
    Template("health_card_label", "es_health_card", 80, "CIP: {}; fin", f"'XY' || {_pad('k', 8)}"),
    Template("registration", "professional_reg", 80, "colegiado {}; fin", f"'28/' || {_pad('k % 100000', 5)}"),
    Template("birth", "birth_or_age", 85, "nacida el {}; fin", f"{_DAY} || '/03/1980'"),
    Template("case", "case_reference", 70, "factura {}; fin", f"'2024/' || {_pad('k % 1000000', 6)}"),
    Template("passport", "passport", 85, "pasaporte nº {}; fin", f"'AAB' || {_pad('k % 1000000', 6)}"),
    Template("plot", "land_registry", 65, "finca {}; fin", "CAST(1000 + k % 9000 AS STRING)"),
    Template("account", "iban", 80, "cuenta {}; fin", f"'2100041845' || {_pad('k', 10)}"),
]

ENGLISH = [
    Template("nhs", "uk_nhs", 100, "holder {} today", f"{_NHS} || CAST({_NHS_CHECK} % 11 AS STRING)", where=f"{_NHS_CHECK} <> 10"),
    Template("nino", "uk_nino", 100, "holder {} today", f"'AB' || {_pad('k % 1000000', 6)} || 'C'"),
    Template("ssn", "us_ssn_itin", 100, "holder {} today", "'123-' || CAST(10 + k % 89 AS STRING) || '-' || CAST(1000 + k % 9000 AS STRING)"),
    Template("ssn_plain", "us_ssn_itin", 100, "holder {} today", "'123' || CAST(10 + k % 89 AS STRING) || CAST(1000 + k % 9000 AS STRING)"),
    Template("itin", "us_ssn_itin", 100, "holder {} today", f"'9' || {_pad('k % 100', 2)} || '-70-' || {_pad('k % 10000', 4)}"),
    Template("us_phone", "phone", 40, "line {} busy", f"'212.555.' || {_pad('k % 10000', 4)}"),
    Template("uk_phone", "phone", 75, "call {} now", f"'020 7946 ' || {_pad('k % 10000', 4)}"),
    Template("uk_postcode", "place_or_postcode", 100, "near {} now", "'SW' || CAST(k % 9 + 1 AS STRING) || 'A 1AA'"),
    Template("us_zip", "place_or_postcode", 100, "near {} now", "CAST(10000 + k % 80000 AS STRING) || '-1234'"),
    Template("street", "address", 50, "at {} now", "CAST(k % 900 + 1 AS STRING) || ' High Street'"),
    Template("date", "date", 40, "seen {} again", "'13/03/' || CAST(2000 + k % 25 AS STRING)"),
    Template("iso_date", "date", 50, "seen {} again", "CAST(2000 + k % 25 AS STRING) || '-03-05'"),
    Template("month_day", "date", 60, "seen {} again", "'March ' || CAST(k % 28 + 1 AS STRING) || ', 2024'"),
    Template("day_month", "date", 60, "seen {} again", "CAST(k % 28 + 1 AS STRING) || ' March 2024'"),
    Template("month", "date", 45, "seen {} again", "'March ' || CAST(1990 + k % 30 AS STRING)"),
    Template("age", "birth_or_age", 55, "is {} now", "CAST(k % 80 + 18 AS STRING) || ' years old'"),
    Template("aged", "birth_or_age", 55, "is {} now", "'aged ' || CAST(k % 80 + 18 AS STRING)"),
    Template("company", "organisation", 45, "with {}, still", f"{_capital()} || 'cme Trading Ltd'"),
    Template("court", "organisation", 50, "before {}, still", f"'High Court of ' || {_capital()} || 'ondon'"),
    Template("role_name", "person", 85, "Client: {}; end", f"'Anna ' || {_capital()} || 'mith'"),
    Template("title_name", "person", 70, "with Mrs {}; end", f"'Anna ' || {_capital()} || 'mith'"),
    Template("clinician", "clinician", 70, "with Nurse {}; end", f"'Anna ' || {_capital()} || 'mith'"),
    Template("record", "medical_record", 75, "MRN: {}; end", "CAST(100000 + k AS STRING)"),
    Template("birth", "birth_or_age", 85, "born on {}; end", f"{_DAY} || '/03/1980'"),
    Template("case", "case_reference", 70, "invoice no. {}; end", f"'AB-' || {_pad('k % 100000', 5)}"),
    Template("passport", "passport", 85, "passport {}; end", f"'X' || {_pad('k % 10000000', 7)}"),
]
_WHO = f"'Ana ' || {_capital()} || 'omez Ruiz'"
_NEXT = "CAST(k % 9 + 1 AS STRING)"

#: Further forms of labels and values, and texts in which nothing must be found (where: false).
SPANISH_FORMS = [
    Template("court", "organisation", 60, "ante el {}; fin", f"'Juzgado de lo Social nº ' || {_NEXT} || ' de Las Palmas'"),
    Template("court", "organisation", 60, "ante el {}; fin", f"'Juzgado de Primera Instancia n.º ' || {_NEXT} || ' de Arrecife'"),
    Template("court", "organisation", 60, "ante la {}; fin", "'Audiencia Provincial de Toledo'"),
    Template("birth", "birth_or_age", 85, "F Nac.: {}; fin", f"{_DAY} || '/02/1980'"),
    Template("birth", "birth_or_age", 85, "F. de nac. {}; fin", f"{_DAY} || '-02-1980'"),
    Template("birth", "birth_or_age", 85, "FECHA NAC: {}; fin", f"{_DAY} || '.02.1980'"),
    Template("birth", "birth_or_age", 85, "nacido {}; fin", f"{_DAY} || ' de marzo de 1980'"),
    Template("role_name", "person", 85, "atn: {}; fin", _WHO),
    Template("role_name", "person", 85, "A LA ATENCIÓN DE : {}; fin", _WHO),
    Template("role_name", "person", 85, "Nombre y apellidos: {} DNI; fin", _WHO),
    Template("record", "medical_record", 75, "n historia {}; fin", _pad("k", 5)),
    Template("record", "medical_record", 75, "Nº de historia clínica: {}; fin", f"'AB-' || {_pad('k', 6)} || '/2'"),
    Template("record", "medical_record", 75, "historia clínica nº {}; fin", _pad("k", 6)),
    Template("record", "medical_record", 75, "N.H.C. {}; fin", _pad("k", 6)),
    Template("registration", "professional_reg", 80, "n col {}; fin", _pad("k % 100000", 5)),
    Template("registration", "professional_reg", 80, "Nº de col. {}; fin", f"'28/' || {_pad('k % 10000', 4)} || '/7'"),
    Template("street", "address", 60, "en {}; fin", f"'Avda. Marítima, nº ' || {_NEXT} || ', 2ºB'"),
    Template("street", "address", 60, "en {}; fin", f"'C/ Sol, ' || {_NEXT} || ', piso 3 dcha. C'"),
    Template("phone", "phone", 80, "lo están llamando del {} hoy", f"'6' || {_pad('k % 100000000', 8)}"),
    Template("phone", "phone", 80, "los móviles son {} y otros", f"'7' || {_pad('k % 100000000', 8)}"),
    Template("street", "address", 95, "ambos viven en {}; fin", "'Paseo Alto ' || CAST(k % 90 + 1 AS STRING)"),
    Template("case", "case_reference", 70, "expte. {}; fin", f"'2020/' || {_pad('k % 10000', 4)} || '-AB'"),
    Template("company", "organisation", 55, "con {}, hoy", f"{_capital()} || 'ares Norte e Hijos, S.A.U'", shown="'Hijos, S.A.U'"),
    Template("national_id", "es_national_id", 100, "documento {} vigente", f"'0' || substr({_pad('k', 7)}, 1, 1) || '.' || substr({_pad('k', 7)}, 2, 3) || '.' || substr({_pad('k', 7)}, 5, 3) || '-' || {_letter('k % 23')}"),
    Template("national_id", "", 0, "documento {} vigente", f"{_pad('k', 8)} || {_letter('(k + 1) % 23')}", where="false"),
    Template("foreigner_id", "", 0, "documento {} vigente", f"'X-' || {_pad('k', 7)} || '-' || {_letter('(k + 1) % 23')}", where="false"),
    Template("phone", "", 0, "llamar al {} hoy", f"'5' || {_pad('k % 100000000', 8)}", where="false"),
    Template("company_id", "", 0, "emisor {} activo", f"'B-' || {_COMPANY} || CAST((11 - ({_COMPANY_SUM}) % 10) % 10 AS STRING)", where="false"),
    Template("plate", "", 0, "un coche {} rojo", f"{_pad('k % 10000', 4)} || ' AEI'", where="false"),
    Template("land_registry", "", 0, "código {} dado", "'ABCDEFGHIJKLMNOPQRST'", where="false"),
    Template("postcode", "", 0, "municipio {} norte", f"'99' || {_pad('k % 1000', 3)}", where="false"),
    Template("age", "", 0, "lleva {} ya", "CAST(k % 80 + 18 AS STRING) || ' años de tratamiento'", where="false"),
    Template("company", "", 0, "la palabra {} aquí", f"{_capital()} || 'NIEZUTE'", where="false"),
    Template("centre", "", 0, "la {} previa", "'historia clínica'", where="false"),
]
ENGLISH_FORMS = [
    Template("iban_digits", "iban", 100, "pay to {} now", f"'ES' || {_pad('98 - (k * 1000000 + 142800) % 97', 2)} || {_pad('k', 20)}"),
    Template("court", "organisation", 50, "before {}; end", "'the Family Court of Leeds North'"),
    Template("street", "address", 50, "at {}; end", f"{_NEXT} || 'B Old Mill Hill Road'"),
    Template("record", "medical_record", 75, "Medical Record No: {}; end", f"'AB-' || {_pad('k', 6)} || '-1'"),
    Template("birth", "birth_or_age", 85, "D.O.B. {}; end", f"'March ' || {_NEXT} || ', 1980'"),
    Template("role_name", "person", 85, "NEXT OF KIN: {}; end", f"'Anna van ' || {_capital()} || 'mith'"),
    Template("nhs", "", 0, "holder {} today", f"{_NHS} || CAST(({_NHS_CHECK} + 1) % 10 AS STRING)", where="false"),
    Template("nino", "", 0, "holder {} today", f"'DQ' || {_pad('k % 1000000', 6)} || 'C'", where="false"),
    Template("ssn", "", 0, "holder {} today", f"'000-' || CAST(10 + k % 89 AS STRING) || '-' || CAST(1000 + k % 9000 AS STRING)", where="false"),
    Template("us_zip", "", 0, "near {} now", "CAST(10000 + k % 80000 AS STRING)", where="false"),
    Template("us_phone", "", 0, "line {} busy", f"'112.555.' || {_pad('k % 10000', 4)}", where="false"),
]
TEMPLATES = {"es": SPANISH, "en": ENGLISH, "es forms": SPANISH_FORMS, "en forms": ENGLISH_FORMS}


def spread(keys: DataFrame, key: str) -> DataFrame:
    """The keys dealt over the session's cores: each gives many texts, so that a file too small to split is work for all."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, key)


def texts(keys: DataFrame, key: str, language: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, block, text, language): for each key one text of each template, numbered by `block` from 0; and columns to keep."""
    each: Column = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(t.text()).alias("text")) for i, t in enumerate(TEMPLATES[language])])
    made = spread(keys.select(F.col(key).cast("bigint").alias("k"), *keep), "k").select("k", *keep, F.explode(each).alias("t"))
    return made.select(F.col("k").alias("key"), "t.block", "t.text", F.lit(language[:2]).alias("language"), *keep)


def expected_sql(table: str, key: str, language: str) -> str:
    """SQL for (key, block, place, detector, category, score, value): the detections that texts() of a table must give."""
    parts = []
    for i, t in enumerate(TEMPLATES[language]):
        for place, (detector, category, score, value) in enumerate(t.expected()):
            parts.append(f"SELECT k AS key, {i} AS block, {place} AS place, '{detector}' AS detector, '{category}' AS category, {score} AS score, {value} AS value FROM t WHERE {t.where}")
    return f"WITH t AS (SELECT CAST({key} AS BIGINT) AS k FROM {table}) " + " UNION ALL ".join(parts)


#: Words that reports are made of (this project's own).
FIRST_NAMES = "Marta Jorge Nuria Pablo Irene Hugo Clara Iván Sonia Bruno Alba Óscar".split()
LAST_NAMES = "Vidal Serrano Molina Ortega Campos Navarro Iglesias Rubio Castaño Peña Ibáñez Soler".split()
STREETS = ["Calle Nueva 14", "Avenida del Puerto 3", "Plaza Mayor 21", "Paseo de la Estación 8", "Camino Viejo 112"]
PLACES = ["Villanueva del Mar", "Puerto Real", "Fuente Clara", "Monteverde"]
CENTRES = ["Hospital Santa Lucía", "Centro de Salud Norte", "Clínica Los Robles", "Hospital Universitario Central"]
DEPARTMENTS = ["Servicio de Neumología", "Unidad de Traumatología", "Sección de Reumatología", "Servicio de Oftalmología"]


def _pick(values: list[str], step: int) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST((k * {step} + {step}) % {len(values)} + 1 AS INT))"


def _name(step: int) -> str:
    return f"{_pick(FIRST_NAMES, step)} || ' ' || {_pick(LAST_NAMES, step + 2)} || ' ' || {_pick(LAST_NAMES, step + 6)}"


#: What a report holds: the text before each value, the value's category, and the value.
REPORT = [
    ("INFORME DE ALTA\n", "health_centre", _pick(CENTRES, 1)), ("\n", "department", _pick(DEPARTMENTS, 3)), ("\n\nPaciente: ", "person", _name(1)),
    ("\nDNI: ", "es_national_id", f"{_pad('10000000 + k', 8)} || {_letter('(10000000 + k) % 23')}"), ("  NHC: ", "medical_record", "CAST(200000 + k AS STRING)"),
    ("  CIP: ", "es_health_card", f"'BBBBBBBBCD' || {_pad('k % 1000000', 6)}"), ("\nNUSS: ", "es_social_security", f"'28 ' || {_pad('10000000 + k', 8)} || ' ' || {_pad('(2810000000 + k) % 97', 2)}"),
    ("\nFecha de nacimiento: ", "birth_or_age", f"{_DAY} || '/05/1971'"), ("\nDomicilio: ", "address", _pick(STREETS, 1)), (", ", "place_or_postcode", _pick(PLACES, 1)),
    ("\nTeléfono: ", "phone", f"'6' || {_pad('k % 100', 2)} || ' 45 ' || {_pad('k % 89 + 10', 2)} || ' 12'"), ("  Correo: ", "email", "'paciente' || CAST(k AS STRING) || '@correo.example'"),
    ("\n\nMotivo de consulta: tos desde hace tres semanas.\nAcude el ", "date", "CAST(k % 28 + 1 AS STRING) || ' de abril de 2023'"), (" con su hermano, D. ", "person", _name(5)),
    (".\nExploración sin hallazgos. Control habitual.\nPróxima revisión: ", "date", f"{_DAY} || '/06/2023'"), (".\n\nFdo.: Dra. ", "clinician", _name(7)), (". Nº Col.: ", "professional_reg", f"'28/28/' || {_pad('k % 100000', 5)}"),
]


def reports(keys: DataFrame, key: str) -> DataFrame:
    """(doc, text, truth): for each key a clinical report with seventeen values, and what they are."""
    k = spread(keys.select(F.col(key).cast("bigint").alias("k")), "k")
    parts = [x for before, _, sql in REPORT for x in (F.lit(before), F.expr(sql))]
    truth = F.array(*[F.struct(F.lit(c).alias("category"), F.expr(sql).alias("value")) for _, c, sql in REPORT])
    return k.select(F.col("k").alias("doc"), F.concat(*parts, F.lit(".\n")).alias("text"), truth.alias("truth"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _paragraph(text: str, more: str = "") -> str:
    half = len(text) // 2
    runs = "".join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in (text[:half], text[half:]))
    return f'<w:p w:rsidR="00A1B2">{runs}{more}</w:p>'


def word_file(lines: list[str], header: str, secret: str) -> bytes:
    """A Word file with a paragraph for each line and one in the header; the secret stands where nobody sees it."""
    gone = f'<w:del w:author="{secret}"><w:r><w:delText>{secret}</w:delText></w:r></w:del>'
    return packed({
        "word/document.xml": f"<w:document {_W}><w:body>{''.join(_paragraph(x, gone) for x in lines)}</w:body></w:document>".encode(),
        "word/header1.xml": f"<w:hdr {_W}>{_paragraph(header)}</w:hdr>".encode(),
        "word/comments.xml": f"<w:comments {_W}>{secret}</w:comments>".encode(),
        "word/_rels/document.xml.rels": _RELS.format(f'<Relationship Id="r1" Target="mailto:{secret}" TargetMode="External"/><Relationship Id="r2" Target="header1.xml"/>').encode(),
        "docProps/core.xml": f"<p>{secret}</p>".encode(),
    })


def excel_file(texts: list[str], day: int, code: int, header: str, secret: str) -> bytes:
    """An Excel file with two headed rows: shared texts, a date by its number of days, a number with leading zeros."""
    strings = "".join(f"<si><t>{escape(t)}</t></si>" for t in ["Correo", "Fecha", "Clave", *texts])
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
    rows += "".join(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i + 3}</v></c><c r="B{i + 2}" s="1"><v>{day + i}</v></c><c r="C{i + 2}" s="2"><v>{code}</v></c></row>' for i in range(len(texts)))
    return packed({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="Datos" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": _RELS.format('<Relationship Id="r1" Target="worksheets/one.xml"/>').encode(),
        "xl/sharedStrings.xml": f"<sst {_S}>{strings}</sst>".encode(),
        "xl/styles.xml": f'<styleSheet {_S}><numFmts><numFmt numFmtId="170" formatCode="00000000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'.encode(),
        "xl/worksheets/one.xml": f"<worksheet {_S}><sheetData>{rows}</sheetData><headerFooter><oddFooter>&amp;C{escape(header)}</oddFooter></headerFooter></worksheet>".encode(),
        "xl/comments1.xml": f"<c>{secret}</c>".encode(),
        "docProps/core.xml": f"<p>{secret}</p>".encode(),
    })


def office_files(keys: DataFrame, key: str) -> DataFrame:
    """(path, content, error): for each key a Word file and an Excel file, made in the tasks."""

    def run(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                mail, day = f"u{k}@x.org", 45292 + k % 300  # days from the end of 1899: the year 2024
                out.append((f"{k}.docx", word_file([f"Escribir a {mail} & Cía", "sin datos", f"o a {mail}"], f"De {mail}", mail)))
                out.append((f"{k}.xlsx", excel_file([f"a {mail}!", "nada"], day, k, f"por {mail}", mail)))
            paths, contents = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    made = keys.select(F.col(key).cast("bigint").alias("k")).mapInArrow(run, "path string, content binary")
    return made.withColumn("error", F.lit(None).cast("string"))
