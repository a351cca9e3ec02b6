"""What is looked for: recognizers of both detection languages, as data over velar.plans.grammar.

A recognizer has one pattern for spans, or for a value behind a label (group 1, at the match's end). `check` names tests
of velar.functions.checks, any of which must pass; `sure` raises the score of what passed to 1. `near` are words that
raise the score by BOOST, to BOOSTED at least, where one of them is part of one of the five tokens before a span, or
has the same stem as one.
`cased` patterns tell capitals from small letters. A recognizer runs only on texts that can match: with one of the
tokens `words`, if any are named, past its `gate`: "digits" (six digits close together), "digit", a literal, or "", and
with as many digits as any match holds, `least`.
"""

from __future__ import annotations

from dataclasses import dataclass

from velar.plans.grammar import END, NUMBER_SIGN, START, Token, any_of, groups, labelled, phrase, sequence, tokens_of, words

THRESHOLD, BOOST, BOOSTED = 0.35, 0.35, 0.4
#: Digits that a match of an identifier's form has at least, by name and category.
LEAST_DIGITS = {
    ("iban_digits", "iban"): 10, ("card", "payment_card"): 13, ("national_id", "es_national_id"): 8, ("foreigner_id", "es_national_id"): 7, ("social_security", "es_social_security"): 11,
    ("phone", "phone"): 9, ("company_id", "es_company_tax_id"): 7, ("plate", "plate"): 4, ("old_plate", "plate"): 4, ("date", "date"): 4, ("iso_date", "date"): 8,
    ("island_postcode", "place_or_postcode"): 5, ("postcode", "place_or_postcode"): 5, ("account", "iban"): 20, ("nhs", "uk_nhs"): 10, ("ssn", "us_ssn_itin"): 9,
    ("ssn_plain", "us_ssn_itin"): 9, ("itin", "us_ssn_itin"): 9, ("us_phone", "phone"): 10, ("uk_phone", "phone"): 9, ("us_zip", "place_or_postcode"): 9,
}


@dataclass(frozen=True)
class Recognizer:
    name: str
    category: str
    pattern: str
    score: float
    check: tuple[str, ...] = ()
    sure: bool = False
    group: int = 0
    near: tuple[str, ...] = ()
    cased: bool = False
    gate: str = "digit"
    words: tuple[str, ...] = ()

    @property
    def least(self) -> int:
        """How many digits a match has at least, by the parts of the pattern that say so outright."""
        return max(LEAST_DIGITS.get((self.name, self.category), 0), {"digits": 6, "digit": 1}.get(self.gate, 0))

    def regex(self) -> str:
        """Classes of letters and digits, and letter case, cover all of Unicode."""
        return ("(?U)" if self.cased else "(?iuU)") + self.pattern


def _shape(name: str, category: str, body: str, score: float, check: tuple = (), sure: bool = False, near: str = "", cased: bool = False, gate: str = "digits") -> Recognizer:
    """An identifier known by its form, with no letter or digit around it."""
    return Recognizer(name, category, START + body + END, score, check, sure, near=tuple(near.split()), cased=cased, gate=gate)


def _labelled(name: str, category: str, labels: list[str], value: str, score: float, gate: str = "digit") -> Recognizer:
    return Recognizer(name, category, labelled(labels, value), score, group=1, gate=gate, words=tuple(tokens_of(labels)))


# --- fixed values: words of forms, offices, streets, businesses, in both languages -----------------------------------
ES_ROLES = (
    "paciente, nombre, nombre del paciente, nombre de paciente, nombre y apellidos, apellidos, apellidos y nombre, cliente, interesado, interesada, titular, solicitante, "
    "demandante, demandado, demandada, denunciante, denunciado, denunciada, querellante, trabajador, trabajadora, empleado, empleada, contratante, arrendador, arrendadora, "
    "arrendatario, arrendataria, comprador, compradora, vendedor, vendedora, propietario, propietaria, destinatario, destinataria, remitente, beneficiario, beneficiaria, "
    "asegurado, asegurada, tomador, tomadora, representante, apoderado, apoderada, firmante, usuario, usuaria, socio, socia, a la atención de, att., attn., atn."
).split(", ")
EN_ROLES = (
    "patient, name, full name, client, claimant, defendant, plaintiff, complainant, applicant, appellant, respondent, witness, employee, employer, tenant, landlord, buyer, "
    "seller, purchaser, vendor, owner, holder, beneficiary, insured, policyholder, customer, signatory, attorney, guardian, next of kin, referred by, attention, attn."
).split(", ")
ES_FORM_WORDS = "dni nie nhc cip nuss tis tel tfno sexo edad fecha domicilio correo historia episodio".split()
ES_PARTICLES, EN_PARTICLES = "de del la las lo los y".split(), "van von de del la le di da of".split()
ES_TITLES, EN_TITLES = ["D.", "Dña.", "Don", "Doña", "Sr.", "Sra."], "Mr Mrs Ms Miss Mx Dr Prof Sir Dame Lord Lady".split()
ES_SIGNATURES = "dr. dra. doctor doctora fdo. firmado enf. d.u.e. prof. lcdo. lcda. ldo. lda.".split()
EN_CLINICIANS = "Dr Doctor Consultant Physician Surgeon Nurse".split()
ES_DURATIONS = (
    "evolución, antigüedad, tratamiento, seguimiento, diagnóstico, abstinencia, consumo, hábito, profesión, matrimonio, jubilación, edad gestacional"
).split(", ")
ES_STREETS = (
    "c/, c., calle, avenida, avda., av., plaza, pza., pl., paseo, pº, carretera, ctra., camino, cmno., urbanización, urb., barrio, bº, rambla, travesía, trva., lugar"
).split(", ")
ES_FLOORS = "piso puerta pta. esc. bajo ático izq. dcha.".split()
EN_STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Place Pl Square Sq Way Close Crescent Terrace Gardens Row".split()
ES_COMPANY_FORMS = ["S.L.", "S.A.", "S.L.U.", "S.A.U.", "S.L.P.", "S.C.P.", "S.Coop.", "C.B.", "A.I.E.", "U.T.E."]
EN_COMPANY_FORMS = (
    "Ltd Limited LLP LLC Inc Incorporated Corp Corporation Company Co PLC plc Group Holdings Partners Associates Trust Foundation University Hospital Clinic Bank"
).split()
ES_OFFICES = "Juzgado Tribunal Audiencia Fiscalía Notaría Registro".split()
EN_COURTS = "High Crown County Magistrates Magistrates' Supreme District Circuit Family Superior".split()
ES_DEPARTMENTS = "servicio servicios unidad unidades sección secciones departamento departamentos consulta consultas".split()
ES_CENTRES = ["complejo hospitalario", "hospital", "hospital universitario", "centro de salud", "clínica", "consultorio"]
CENTRE_LETTERS = "HUNSC HUC CHUC CHUIMI CHUNSC HGLP HUGCDN HIUMI SCS".split()
REGIONAL_SERVICES = ["Servicio Canario de Salud", "Servicio Canario de la Salud"]
REGIONAL_BOARDS = ["Gerencia de Atención Primaria", "Gerencia de Servicios Sanitarios"]
#: Words that end the name of a department or centre: what a form puts after it.
ES_SECTIONS = (
    "servicio unidad sección departamento consulta gerencia paciente nombre apellidos informe historia fecha dr dra fdo tel teléfono tfno nhc dni cip "
    "ctra calle avda avenida plaza pza paseo camino urb barrio nº n num núm número"
).split()
ES_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre".split()
EN_MONTHS = (
    "January Jan February Feb March Mar April Apr May June Jun July Jul August Aug September Sept Sep October Oct November Nov December Dec"
).split()

# --- labels of the values behind them ---------------------------------------------------------------------------------
ES_RECORD = ["nhc", "n.h.c.", "# [de] historia [clínica]", "historia clínica", "hª", "h.ª", "hc"]
ES_EPISODE = ["episodio", "caso", "proceso", "ingreso"]
ES_HEALTH_CARD = ["cip", "cip aut", "cip sns", "cip scs", "cip-aut", "cip-sns", "cip-scs", "cipa", "t.i.s.", "tarjeta sanitaria"]
ES_REGISTRATION = ["colegiado", "colegiada", "# [de] col.", "# [de] colegiado", "# [de] colegiada"]
ES_BIRTH = ["fecha [de] nacimiento", "fecha [de] nac.", "f.? [de] nacimiento", "f.? [de] nac.", "f.nac.", "nacido [el]", "nacida [el]"]
ES_CASE = (
    "expediente, expte., procedimiento, autos, diligencias, protocolo, póliza, contrato, factura, albarán, pedido, presupuesto, referencia, n.i.g., siniestro, ticket, caso"
).split(", ")
ES_PLOT = ["finca", "finca registral", "parcela", "polígono"]
ES_ACCOUNT = ["c.c.c.", "cuenta", "cuenta bancaria", "nº de cuenta"]
EN_RECORD = ["m.r.n.", "medical record", "medical record no", "medical record number", "hospital no", "hospital number", "record no", "record number", "chart no", "chart number"]
EN_BIRTH = ["d.o.b.", "date of birth", "born", "born on"]
EN_CASE = "case, file, claim, matter, invoice, order, policy, contract, reference, ref, purchase order, p.o., docket".split(", ")

# --- values -----------------------------------------------------------------------------------------------------------
GAP = r"[\s\-]?"
DATE, ISO = r"\d{1,2}[/\-.]\d{1,2}[/\-.](?:\d{4}|\d{2})", r"\d{4}-\d{2}-\d{2}"
#: Values as tokens, with their limits: letters, then digits, then groups of digits behind a sign.
RECORD = sequence(Token("letters", 0, 3), Token("digits", 2, 12, " -/", loose=True), Token("digits", 0, 10, "-/"))
LONG_RECORD = sequence(Token("letters", 0, 3), Token("digits", 4, 12, " -/", loose=True), Token("digits", 0, 10, "-/"))
CODE = sequence(Token("letters", 0, 6), Token("digits", 2, None, " -/", loose=True), Token("digits", 0, 6, "-/.", times=4), Token("letters", 0, 4, "-/"))
ES_WORD, EN_WORD = sequence(Token("capital", 1, 1), Token("letter", 1, None)), r"\p{Lu}[\p{L}'’\-]+"
ES_NAME = words(ES_WORD, ES_WORD, 6, join="[ ,]+", particles=ES_PARTICLES, stops=ES_FORM_WORDS)
EN_NAME = words(EN_WORD, EN_WORD, 4, particles=EN_PARTICLES)
#: What stands behind a street: numbers, floors and doors, each with a letter of its own.
DOOR = rf"(?:(?:{NUMBER_SIGN}\s*)?\d{{1,4}}\s?[ºª°]?(?:\s?[A-Z](?![\p{{L}}\p{{N}}]))?|{any_of(ES_FLOORS)}(?:\s+[A-Z](?![\p{{L}}\p{{N}}]))?)"
ES_ADDRESS = rf"{any_of(ES_STREETS)}\s+\p{{L}}[^,;\n\r]{{2,50}}(?:\s*[,\-]?\s*{DOOR}){{0,6}}"
EN_ADDRESS = words(r"\d{1,5}[A-Z]?", r"[A-Z]\p{L}+", 4) + r"\s+" + any_of(EN_STREETS)
#: Names of bodies: some capital words, in front of a company form or behind an office.
BUSINESS, JOINED_FORM = r"\p{Lu}[\p{L}&]*", r"(?:\s*,\s*|\s+)"
ES_COMPANY = words(BUSINESS, BUSINESS, 4, least=0) + JOINED_FORM + any_of(ES_COMPANY_FORMS)
EN_COMPANY = rf"(?!{any_of(EN_TITLES)}{END})" + words(r"\p{Lu}[\p{L}&'’\-]+", r"\p{Lu}[\p{L}&'’\-]*", 4, least=0) + r"\s+" + any_of(EN_COMPANY_FORMS)
_SEAT = dict(particles=[*ES_PARTICLES, "en"])
ES_COURT = words(any_of(ES_OFFICES), r"\p{Lu}\w*", 6, **_SEAT) + rf"(?:\s+{NUMBER_SIGN}\s*\d{{1,4}}{phrase(r'\p{Lu}\w*', 4, least=0, **_SEAT)})?"
EN_COURT = rf"(?:the\s+)?{any_of(EN_COURTS)}\s+Court(?:\s+of{phrase(EN_WORD, 3)})?"
#: Departments and centres end before a word that a form puts after them; signatures go on over particles and initials.
ES_DEPARTMENT = any_of(ES_DEPARTMENTS) + r"\s+de\s+" + words(r"\p{L}\w*", r"\p{L}\w*", 6, join=r"(?:\s*,\s*|\s+[ye]\s+|\s+)", stops=ES_SECTIONS, least=0)
ES_CENTRE = r"(?<!historia )(?<!Historia )" + words(any_of(ES_CENTRES), r"\p{L}[\w\-]*", 7, particles=["de", "del", "la", "los"], stops=ES_SECTIONS)
ES_SIGNED = words(any_of(ES_SIGNATURES) + r"\s*:?\s+\p{L}\w+", rf"(?:{any_of(ES_PARTICLES)}{END}|\p{{L}}\w+|\p{{L}}\.)", 5)
TEXT_DATE = r"\d{1,2}\s+de\s+\p{L}+\s+(?:de\s+)?\d{4}"
ORDINAL = r"(?:st|nd|rd|th)?"
ES_MONTH, EN_MONTH = any_of(ES_MONTHS), any_of(EN_MONTHS) + r"\.?"
EN_MONTH_DAY = rf"{EN_MONTH}\s+\d{{1,2}}{ORDINAL},?\s+\d{{4}}"


def _months(names: list[str]) -> tuple[str, ...]:
    return tuple(tokens_of(names))


_SHARED = [
    Recognizer("email", "email", r"(?<![\w.+\-])\w[\w.+\-]*@[\w\-]+\.[\w.\-]+\w(?!\w)", 0.85, gate="@"),
    _shape("iban_digits", "iban", rf"[A-Z]{{2}}\d{{2}}(?:{GAP}\d{{4}}){{2,7}}(?:{GAP}\d{{1,3}})?", 0.5, ("iban",), True, cased=True),
    _shape("iban_letters", "iban", rf"[A-Z]{{2}}\d{{2}}[A-Z]{{4}}(?:{GAP}[A-Z0-9]{{4}}){{2,6}}", 0.5, ("iban",), True, cased=True, gate="digit"),
    _shape("card", "payment_card", rf"[3-6]\d{{3}}{GAP}" + groups(GAP, 4, 4, "1,7"), 0.5, ("payment_card",), True),
]

SPANISH = _SHARED + [
    _shape("national_id", "es_national_id", groups(r"[.\s]?", 2, 3, 3) + r"[\-\s]?[A-Z]", 0.4, ("national_id", "foreigner_id"), True),
    _shape("foreigner_id", "es_national_id", rf"[XYZ]{GAP}\d{{7}}{GAP}[A-Z]", 0.4, ("national_id", "foreigner_id"), True),
    _shape("social_security", "es_social_security", groups(r"[\s/\-.]?", 2, "7,8", 2), 0.3, ("es_social_security",), True),
    Recognizer("phone", "phone", r"(?<![\d/.\-])(?:(?:\+34|0034)[\s.\-]?)?[6-9](?:[\s.\-]?\d){8}(?![\d/])", 0.45, ("es_phone",), near=tuple("teléfono telefono tfno tel móvil movil contacto llamar fax".split()), gate="digits"),
    _shape("company_id", "es_company_tax_id", rf"[A-HJ-NP-SUVW]{GAP}\d{{7}}{GAP}[0-9A-J]", 0.4, ("es_company_id",), True),
    _shape("plate", "plate", rf"\d{{4}}{GAP}[B-DF-HJ-NPR-TV-Z]{{3}}", 0.5, ("es_plate",), near="matrícula matricula vehículo vehiculo coche turismo furgoneta motocicleta remolque placa", gate="digit"),
    _shape("old_plate", "plate", r"[A-Z]{1,2}[\s\-]\d{4}[\s\-][A-Z]{1,2}", 0.3, ("es_plate",), near="matrícula matricula vehículo vehiculo coche turismo furgoneta motocicleta remolque placa", gate="digit"),
    _shape("land_registry", "land_registry", r"[A-Z0-9]{20}", 0.6, ("land_registry",), near="catastral catastro inmueble finca parcela referencia", cased=True, gate="digit"),
    Recognizer("company", "organisation", START + ES_COMPANY + END, 0.55, cased=True, gate="", words=tuple(sorted({*tokens_of(ES_COMPANY_FORMS), "scoop", "coop"}))),
    Recognizer("court", "organisation", START + ES_COURT, 0.6, cased=True, gate="", words=tuple(tokens_of(ES_OFFICES))),
    _shape("health_card", "es_health_card", r"B{8}[A-Z]{2}\d{6}", 0.9, near="cip tis tarjeta sanitaria sns"),
    _shape("health_card_any", "es_health_card", r"[A-Z]{2,10}\d{6,14}", 0.2, near="cip tis tarjeta sanitaria sns"),
    _shape("date", "date", DATE, 0.6, gate="digit"),
    _shape("iso_date", "date", ISO, 0.6, gate="digit"),
    Recognizer("long_date", "date", rf"{START}\d{{1,2}}\s+de\s+{ES_MONTH}\s+(?:del?\s+)?\d{{4}}{END}", 0.75, words=_months(ES_MONTHS)),
    Recognizer("month", "date", rf"{START}{ES_MONTH}\s+(?:del?\s+)?\d{{4}}{END}", 0.5, words=_months(ES_MONTHS)),
    Recognizer("age", "birth_or_age", rf"{START}\d{{1,3}}\s+años(?:\s+de\s+edad)?{END}(?!\s+de\s+{any_of(ES_DURATIONS)})", 0.5, near=tuple("edad paciente varón varon mujer niño niña".split()), words=("años",)),
    Recognizer("age_months", "birth_or_age", rf"{START}\d{{1,2}}\s+meses\s+de\s+edad{END}", 0.6, near=tuple("edad paciente varón varon mujer niño niña".split()), words=("meses",)),
    _shape("island_postcode", "place_or_postcode", r"3[58]\d{3}", 0.5, ("es_postcode",), near="cp c.p código postal dirección direccion domicilio calle municipio", gate="digit"),
    _shape("postcode", "place_or_postcode", r"\d{5}", 0.15, ("es_postcode",), near="cp c.p código postal dirección direccion domicilio calle municipio", gate="digit"),
    Recognizer("street", "address", START + ES_ADDRESS, 0.6, near=tuple("domicilio dirección direccion residente vive".split()), gate="", words=tuple(tokens_of(ES_STREETS))),
    Recognizer("department", "department", START + ES_DEPARTMENT, 0.55, gate="", words=tuple(tokens_of(ES_DEPARTMENTS))),
    Recognizer("centre", "health_centre", START + ES_CENTRE, 0.6, gate="", words=tuple(tokens_of(ES_CENTRES))),
    Recognizer("centre_letters", "health_centre", rf"{START}{any_of(CENTRE_LETTERS)}{END}", 0.7, gate="", words=tuple(tokens_of(CENTRE_LETTERS))),
    Recognizer("regional_service", "health_centre", rf"{START}(?:{any_of(REGIONAL_SERVICES)}|{any_of(REGIONAL_BOARDS)}[^\n,;]{{0,40}})", 0.75, gate="", words=("canario", "gerencia")),
    Recognizer("signature", "clinician", START + ES_SIGNED, 0.7, gate="", words=tuple(tokens_of(ES_SIGNATURES))),
    Recognizer("sex", "sex", rf"{START}sexo\s*:?\s*(?:{any_of(['varón', 'mujer', 'hombre', 'masculino', 'femenino'])}|[VMH]){END}", 0.85, gate="", words=("sexo",)),
    Recognizer("sex_phrase", "sex", rf"{START}{any_of(['varón', 'mujer', 'niño', 'niña'])}\s+de\s+\d{{1,3}}\s+(?:años|meses){END}", 0.5, words=("años", "meses")),
    Recognizer("role_name", "person", labelled(ES_ROLES, ES_NAME, r"\s*:\s*"), 0.85, group=1, cased=True, gate=":", words=tuple(tokens_of(ES_ROLES))),
    Recognizer("title_name", "person", rf"{START}{any_of(ES_TITLES)}\s+({ES_NAME})", 0.7, group=1, cased=True, gate="", words=tuple(tokens_of(ES_TITLES))),
    _labelled("record", "medical_record", ES_RECORD, RECORD, 0.75),
    _labelled("episode", "medical_record", ES_EPISODE, LONG_RECORD, 0.6),
    _labelled("health_card_label", "es_health_card", ES_HEALTH_CARD, r"[A-Z]{0,10}\d{6,16}", 0.8, "digits"),
    _labelled("registration", "professional_reg", ES_REGISTRATION, r"\d{2,9}(?:[/\-]\d{1,9}){0,3}", 0.8),
    _labelled("birth", "birth_or_age", ES_BIRTH, f"{DATE}|{TEXT_DATE}", 0.85),
    _labelled("case", "case_reference", ES_CASE, CODE, 0.7),
    _labelled("passport", "passport", ["pasaporte", "passport"], r"[A-Z]{2,3}\s?\d{6}", 0.85, "digits"),
    _labelled("plot", "land_registry", ES_PLOT, r"\d{1,3}(?:[.\s]\d{3})+|\d{1,7}", 0.65),
    _labelled("account", "iban", ES_ACCOUNT, groups(GAP, 4, 4, 2, 10), 0.8, "digits"),
]

ENGLISH = _SHARED + [
    _shape("nhs", "uk_nhs", groups(GAP, 3, 3, 4), 0.3, ("uk_nhs",), True),
    _shape("nino", "uk_nino", rf"[A-Z]{{2}}{GAP}{groups(GAP, 2, 2, 2)}{GAP}[A-D]", 0.4, ("uk_nino",), True),
    _shape("ssn", "us_ssn_itin", groups(r"[\s\-]", 3, 2, 4), 0.45, ("us_ssn",), True),
    _shape("ssn_plain", "us_ssn_itin", r"\d{9}", 0.2, ("us_ssn",), True),
    _shape("itin", "us_ssn_itin", rf"9\d{{2}}{GAP}{groups(GAP, 2, 4)}", 0.4, ("us_itin",), True),
    Recognizer("us_phone", "phone", r"(?<![\d/.\-])(?:\+1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]?[2-9]\d{2}[\s.\-]?\d{4}(?![\d/])", 0.4, ("us_phone", "uk_phone"), near=tuple("phone tel telephone mobile cell call fax contact".split()), gate="digits"),
    Recognizer("uk_phone", "phone", r"(?<![\d/.\-])(?:\+44[\s.\-]?|0)(?:\d[\s.\-]?){9,10}(?![\d/])", 0.4, ("us_phone", "uk_phone"), near=tuple("phone tel telephone mobile cell call fax contact".split()), gate="digits"),
    _shape("uk_postcode", "place_or_postcode", r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}", 0.6, ("uk_postcode", "us_zip"), True, gate="digit"),
    _shape("us_zip", "place_or_postcode", r"\d{5}-\d{4}", 0.55, ("uk_postcode", "us_zip"), True),
    Recognizer("street", "address", START + EN_ADDRESS + END + r"\.?", 0.5, near=tuple("address street avenue road residing lives".split()), words=tuple(tokens_of(EN_STREETS))),
    _shape("date", "date", DATE, 0.4, near="date dated on signed issued due expiry expires", gate="digit"),
    _shape("iso_date", "date", ISO, 0.5, near="date dated on signed issued due expiry expires", gate="digit"),
    Recognizer("month_day", "date", START + EN_MONTH_DAY + END, 0.6, near=tuple("date dated on signed issued due expiry expires".split()), words=_months(EN_MONTHS)),
    Recognizer("day_month", "date", rf"{START}\d{{1,2}}{ORDINAL}\s+(?:of\s+)?{EN_MONTH},?\s+\d{{4}}{END}", 0.6, near=tuple("date dated on signed issued due expiry expires".split()), words=_months(EN_MONTHS)),
    Recognizer("month", "date", rf"{START}{EN_MONTH}\s+\d{{4}}{END}", 0.45, near=tuple("date dated on signed issued due expiry expires".split()), words=_months(EN_MONTHS)),
    Recognizer("age", "birth_or_age", rf"{START}\d{{1,3}}[\s\-]*years?[\s\-]old{END}", 0.55, near=tuple("age aged old patient".split()), words=("old",)),
    Recognizer("aged", "birth_or_age", rf"{START}aged\s+\d{{1,3}}{END}", 0.55, near=tuple("age aged old patient".split()), words=("aged",)),
    Recognizer("company", "organisation", START + EN_COMPANY + END + r"\.?", 0.45, near=tuple("company court hospital university ltd inc llc".split()), cased=True, gate="", words=tuple(tokens_of(EN_COMPANY_FORMS))),
    Recognizer("court", "organisation", START + EN_COURT + END, 0.5, near=tuple("company court hospital university ltd inc llc".split()), cased=True, gate="", words=("court",)),
    Recognizer("role_name", "person", labelled(EN_ROLES, EN_NAME, r"\s*:\s*"), 0.85, group=1, cased=True, gate=":", words=tuple(tokens_of(EN_ROLES))),
    Recognizer("title_name", "person", rf"{START}{any_of(EN_TITLES)}\.?\s+({EN_NAME})", 0.7, group=1, cased=True, gate="", words=tuple(tokens_of(EN_TITLES))),
    Recognizer("clinician", "clinician", rf"{START}{any_of(EN_CLINICIANS)}\.?\s+({EN_NAME})", 0.7, group=1, cased=True, gate="", words=tuple(tokens_of(EN_CLINICIANS))),
    _labelled("record", "medical_record", EN_RECORD, LONG_RECORD, 0.75),
    _labelled("birth", "birth_or_age", EN_BIRTH, f"{DATE}|{ISO}|{EN_MONTH_DAY}", 0.85),
    _labelled("case", "case_reference", EN_CASE, CODE, 0.7),
    _labelled("passport", "passport", ["passport"], r"[A-Z0-9]{6,9}", 0.85, ""),
]

#: What just before a name makes it a clinician's, and before a date a birth date; by language.
_ES_CLINICIANS = (
    "dr., dra., doctor, doctora, fdo., firmado, enf., d.u.e., médico, médica, facultativo, facultativa, residente, adjunto, adjunta, jefe de servicio, cirujano, cirujana, "
    "pediatra, enfermero, enfermera, matrona, colegiado, colegiada, atendido por, atendida por, valorado por, valorada por, firma"
).split(", ")
_EN_CLINICIANS = "dr., doctor, consultant, physician, surgeon, nurse, signed, signed by, attending, resident, registrar, gp, md, rn, reviewed by, seen by".split(", ")
CLINICIAN_BEFORE = {k: rf"(?iuU){START}{any_of(words)}\s*:?\s*\z" for k, words in (("es", _ES_CLINICIANS), ("en", _EN_CLINICIANS))}
BIRTH_BEFORE = {
    "es": rf"(?iuU){any_of(['nacimiento', 'nacido', 'nacida', 'f.? [de] nac', 'f.nac', 'fecha [de] nac'])}",
    "en": rf"(?iuU){START}{any_of(['date of birth', 'd.o.b.', 'born', 'born on'])}",
}
CLINICIAN_REACH, BIRTH_REACH, CONTEXT_RADIUS = 40, 45, 70
#: Words and signs that a detection never begins or ends with.
EDGE_WORDS = "de del la las los el y e en a con por n nº no núm num nro".split()
EDGE_SIGNS = r".:;,–—\-ºª()\[\]"
#: Words of forms and letters that are labels, not data, by language (this project's own list).
NOISE = {
    "es": (
        "informe teléfono telefono tfno tel fax correo email e-mail fecha nombre apellidos paciente domicilio dirección direccion edad sexo urgencias alta ingreso "
        "diagnóstico tratamiento motivo antecedentes exploración evolución anamnesis alergias historia episodio consulta fdo firmado firma dr dra d don doña dña señor señora sr sra "
        "col dni nif nie nhc cip tis nuss cif iban factura contrato total subtotal importe iva expediente procedimiento autos protocolo póliza pedido albarán presupuesto "
        "referencia finca parcela cliente proveedor cuenta tarjeta vehículo matrícula asunto destinatario remitente trabajador trabajadora empresa observaciones"
    ).split(),
    "en": (
        "report phone telephone tel fax email e-mail date name patient address age sex diagnosis treatment history invoice contract total subtotal amount balance account subject attention "
        "dear sincerely regards page confidential mobile cell contact nhs ssn itin mr mrs ms miss dob mrn ref reference hospital clinic department signed signature notes remarks"
    ).split(),
}
#: What is left beside a blocked place and is no personal data by itself.
ORPHANS = "de del la las los el y e en a con por fdo dr dra nº no col tel tfno cip nhc dni nuss correo paciente".split()
