import random

import pytest
from pyspark.sql import functions as F

from velar.operators import detect, redact, search
from velar.plans import catalog, grammar, recognizers

ES = (
    "Paciente: Lucía Ferrer Vega, DNI 47301928J, nacida el 03/04/1980. Tel. 612 345 678, correo lucia@ejemplo.es. IBAN ES66 2100 0731 6203 0045 8817. "
    "Atendida por Dr. Tomás Rey Blanco, colegiado nº 41/20733. Vive en Calle Mayor 12, 3º. Fecha 12 de marzo de 2024. Tiene 47 años. Lleva 3 años de tratamiento."
)
EN = (
    "Patient: John Smith, NHS 481 230 9751, DOB: 12/04/1980, SSN 412-38-4417. Call 312-555-0147 or mail a.b@c.org. Dr Jane Doe saw the patient "
    "at 12 High Street on January 5, 2024. Card 4000 1234 5678 9017, Invoice no. QX-20733 of the and."
)
WANT = {
    0: {("person", "Lucía Ferrer Vega"), ("es_national_id", "47301928J"), ("birth_or_age", "03/04/1980"), ("phone", "612 345 678"), ("email", "lucia@ejemplo.es"), ("iban", "ES66 2100 0731 6203 0045 8817"), ("clinician", "Tomás Rey Blanco"), ("professional_reg", "41/20733"), ("address", "Calle Mayor 12, 3º"), ("date", "12 de marzo de 2024"), ("birth_or_age", "47 años")},
    1: {("person", "John Smith"), ("uk_nhs", "481 230 9751"), ("birth_or_age", "12/04/1980"), ("us_ssn_itin", "412-38-4417"), ("phone", "312-555-0147"), ("email", "a.b@c.org"), ("clinician", "Jane Doe"), ("address", "12 High Street"), ("date", "January 5, 2024"), ("payment_card", "4000 1234 5678 9017"), ("case_reference", "QX-20733")},
}


def texts(spark):
    return spark.createDataFrame([(0, ES), (1, EN), (2, None), (3, " \n"), (4, "DNI 47301928A, card 4000 1234 5678 9018")], "doc_id long, text string")


def found(df, **options):
    out = {}
    for r in detect.detections(df, ["doc_id"], **options).collect():
        out.setdefault(r.doc_id, set()).add((r.category, r.text))
    return out


def test_both_languages_and_no_false_checks(spark):
    assert found(texts(spark)) == WANT


def test_switches_lists_and_names(spark):
    assert found(texts(spark), categories=["dni_nie", "unknown"]) == {0: {("es_national_id", "47301928J")}}
    assert found(texts(spark), categories=[]) == {}
    got = found(texts(spark), categories=["email", "personalizada"], custom=["colegiado", " ", "saw the"], allow=["A.B@C.ORG "])
    assert got == {0: {("email", "lucia@ejemplo.es"), ("custom_term", "colegiado")}, 1: {("custom_term", "saw the")}}
    assert len(catalog.GROUP_OF) == 29 and catalog.catalog(spark).count() == 29


def fold(text, spans):
    """The overlap rule step by step."""

    def trim(s, a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return [(a, b, *s[2:])] if b - a >= 2 else []

    out = []
    for d in sorted(spans, key=lambda s: (s[0], -s[1], s[3], -s[4], s[5])):
        if not out or d[0] >= out[-1][1]:
            out.append(d)
            continue
        last = out[-1]
        if d[2] == last[2]:
            out[-1] = (last[0], max(last[1], d[1]), last[2], min(last[3], d[3]), max(last[4], d[4]), last[5])
        elif (-d[3], d[4], d[1] - d[0]) > (-last[3], last[4], last[1] - last[0]):
            out[-1:] = [*trim(last, last[0], d[0]), d, *trim(last, d[1], max(d[1], last[1]))]
        else:
            out += trim(d, last[1], max(d[1], last[1]))
    return out


def test_overlaps_against_the_rule(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        text = "".join(rng.choices("abc  d", k=40))
        spans = [(a, a + rng.randint(2, 15), rng.choice("xyz"), rng.choice([1, 1, 2]), rng.choice([0.5, 0.7, 0.85]), rng.choice("pq")) for a in rng.choices(range(25), k=rng.randint(0, 7))]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"i int, text string, spans {detect.EMPTY}")
    for r in df.withColumn("got", detect.resolved(F.col("text"), F.col("spans"))).collect():
        got, before = [tuple(s) for s in r.got], [tuple(s) for s in r.spans]
        assert got == fold(r.text, before)
        covered = {k for s in got for k in range(s[0], s[1])}
        lost = [k for s in before for k in range(s[0], s[1]) if k not in covered and not r.text[k].isspace()]
        assert len(lost) <= len(before)


def test_redaction_second_pass_and_audit(spark):
    df = texts(spark)
    spans_ = detect.with_spans(df)
    done = redact.redacted(spans_, F.lit(30), dates="shift", ages="band", terms=["tratamiento"]).cache()
    text = {r.doc_id: r.redacted for r in done.collect()}
    assert text[2] is None and text[3] == " \n" and "47301928J" not in text[0] and "45-49 años" in text[0] and "11 de abril de 2024" in text[0]
    assert "03/04/1980" not in text[0] and "tratamiento" not in text[0] and "February 4, 2024" in text[1]
    every = detect.detections(df, ["doc_id"])
    counts = {r.category: (r.detected, r.redacted) for r in redact.audit(every, every.where("doc_id = 0"), ["doc_id", "start"]).collect()}
    assert counts["email"] == (2, 1) and counts["iban"] == (1, 1) and counts["uk_nhs"] == (1, 0)


def test_edits_that_overlap(spark):
    edits = [(2, 4, "XY"), (3, 6, None), (8, 8, "no"), (9, 99, ""), (0, 0, None)]
    df = spark.createDataFrame([("abcdefghij", edits)], f"t string, e array<{redact.EDIT}>")
    assert df.select(redact.substituted(F.col("t"), F.col("e")).alias("x")).first().x == "abXY████ghi"


def test_leftovers_and_residuals(spark):
    done = spark.createDataFrame([(1, 0, "Call ████ or"), (1, 1, "ann lee"), (2, 0, None)], "doc_id long, block_id int, redacted string")
    texts_ = spark.createDataFrame([(1, "OR ANN"), (1, "bob"), (1, "or ann "), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in redact.leftovers(done, texts_, "doc_id", "block_id").collect()) == [(1, "OR ANN"), (1, "or ann")]
    cases = [("de la y", True), ("Fdo.:", True), ("nº (DNI)", True), ("abc", True), ("Juan de la Cruz", False), ("a b c d", True), ("12345", False)]
    df = spark.createDataFrame(cases, "text string, want boolean")
    assert df.where(redact.is_orphan(F.col("text")) != F.col("want")).collect() == []
    again = [
        (1, 0, 5, "email", "a@b.org"), (1, 1, 0, "email", "A@B.org "), (1, 0, 30, "date", "01/02/2024"), (1, 0, 40, "birth_or_age", "45-49 años"), (1, 0, 45, "birth_or_age", "47 años"),
        (1, 0, 50, "person", "Dr. ████"), (1, 0, 60, "logo", "some logo"), (1, 0, 70, "person", "No One"), (2, 0, 0, "person", "de la"), (2, 0, 9, "phone", "612345678"),
    ]
    df = spark.createDataFrame(again, "doc_id long, block_id int, start int, category string, text string").withColumn("language", F.lit("es"))
    rejected = spark.createDataFrame([(1, "NO ONE")], "doc_id long, text string")
    got = lambda **o: sorted((r.doc_id, r.text) for r in redact.residuals(df, rejected, "doc_id", **o).collect())
    assert got(dates="shift", ages="band") == [(1, "45-49 años"), (1, "a@b.org"), (2, "612345678")]
    assert got(most=1) == [(1, "a@b.org"), (2, "612345678")] and len(got(most=None)) == 5


def test_audit_record_has_no_values(spark):
    found = spark.createDataFrame([(1, "d0", "email"), (1, "d1", "email"), (1, "d2", "iban"), (2, "d0", "email")], "doc_id long, det_id string, category string")
    yes = spark.createDataFrame([(1, "d0"), (1, "d2"), (1, "d9"), (1, "d0")], "doc_id long, det_id string")
    results = spark.createDataFrame([(1, "secret text", 2), (2, "b", 0), (3, "", 0)], "doc_id long, content string, zones int")
    left = spark.createDataFrame([(1, "secret")], "doc_id long, text string")
    more = spark.createDataFrame([(1, "email"), (1, "email"), (1, "date")], "doc_id long, category string")
    rows = {r.doc_id: r.record.asDict(True) for r in redact.audit_records(results, found, yes, left, more, "doc_id", ["email", "iban"], 1, 2, 3, "shift").collect()}
    one = rows[1]["redaction"]
    assert (one["total"], one["approved"], one["rejected"], one["dates"], one["ages"]) == (2 + 2 + 3, 2, 1, "shifted", "blocked")
    assert one["by_category"] == {"email": {"detected": 2, "redacted": 1}, "iban": {"detected": 1, "redacted": 1}}
    assert rows[1]["second_pass"] == {"leftovers": 1, "residuals": 3, "residuals_by_category": {"date": 1, "email": 2}}
    assert rows[3]["redaction"]["total"] == 3 and all(len(r["sha256"]) == 64 for r in rows.values()) and "secret" not in str(rows)


def test_approvals_by_number(spark):
    df = spark.createDataFrame([(1, 0, "a@b.org c@d.org"), (1, 1, "none"), (1, 2, "e@f.org"), (2, 0, "g@h.org")], "doc_id long, block_id int, text string")
    yes = spark.createDataFrame([(1, "d1"), (1, "d2"), (1, "d7")], "doc_id long, det_id string")
    kept = redact.with_approved_spans(detect.with_spans(df, ["email"]), yes, "doc_id", "block_id")
    got = {(r.doc_id, r.block_id): (r.redacted, r.edits) for r in redact.redacted(kept).collect()}
    assert got == {(1, 0): ("a@b.org ███████", 1), (1, 1): ("none", 0), (1, 2): ("███████", 1), (2, 0): ("g@h.org", 0)}


def test_further_layers(spark):
    ner = [(0, 12, "person", 2, 0.85, "ner"), (20, 23, "person", 2, 0.9, "ner"), (24, 33, "place_or_postcode", 2, 0.2, "ner"), (36, 40, "person", 2, 0.9, "ner")]
    llm = [(14, 19, "person", 3, 0.5, "llm"), (45, 52, "email", 3, 0.5, "llm")]
    text = "Paciente Ana meets X 1, Barcelona    Tel.   a@b.org"
    df = spark.createDataFrame([(1, text, ner, llm)], f"doc_id long, text string, ner {detect.EMPTY}, llm {detect.EMPTY}").withColumn("lang", F.lit("es"))
    rows = detect.detections(df, ["doc_id"], language_col="lang", named="ner", proposed="llm").collect()
    assert sorted((r.layer, r.category, r.text) for r in rows) == [(1, "email", "a@b.org"), (2, "person", "Ana"), (3, "person", "eets")]


def test_each_pattern_runs_once(spark):
    df = texts(spark)
    plan = detect.detections(df, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    for r in (recognizers.SPANISH[0], recognizers.SPANISH[6], recognizers.ENGLISH[4]):
        languages = (r in recognizers.SPANISH) + (r in recognizers.ENGLISH)
        assert plan.count(r.regex()) == 2 * languages, r  # to find it, and to cut the text there
    assert "size(spans" not in plan


def test_scores_with_context(spark):
    cases = [("código postal 28013", "postcode", 0.5), ("28013", None, None), ("matrícula M 1234 AB", "old_plate", 0.65), ("sanitaria XX123456", "health_card_any", 0.55), ("su CP: 35001", "island_postcode", 0.85)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string").withColumn("lang", F.lit("es"))
    got = {}
    for r in detect.detections(df, ["doc_id"], categories=["place_or_postcode", "plate", "es_health_card"], language_col="lang").collect():
        got.setdefault(r.doc_id, []).append((r.detector, r.score))
    for i, (_, detector, score) in enumerate(cases):
        assert (detector, score) in got[i] if detector else i not in got, (i, got)


def test_gates_never_lose_a_match():
    import re

    for r in {*recognizers.SPANISH, *recognizers.ENGLISH}:
        assert all(re.fullmatch("[a-záéíóúñü]+", w) for w in r.words), r
    tokens = lambda t: set(re.findall("[a-záéíóúñü]+", t.lower()))
    for label in [*recognizers.ES_RECORD, *recognizers.ES_BIRTH, *recognizers.ES_REGISTRATION, *recognizers.ES_ROLES, *recognizers.ES_HEALTH_CARD, *recognizers.ES_CASE, *recognizers.ES_ACCOUNT, *recognizers.EN_RECORD, *recognizers.EN_CASE, *recognizers.ES_STREETS, *recognizers.ES_SIGNATURES, *recognizers.ES_COMPANY_FORMS]:
        words = set(grammar.tokens_of([label]))
        forms = [label.replace("#", "nº").replace(".?", "").replace("[", "").replace("]", ""), re.sub(r"\[[^]]*\] ?", "", label).replace("#", "número").replace(".?", ".").strip()]
        for form in forms:
            for spelling in {form, form.replace(".", ""), form.upper()}:
                assert tokens(spelling) & words, (label, spelling)
                assert re.search("(?i)" + grammar.any_of([label]).replace(r"\s", " "), spelling) or re.fullmatch(r"\w\.", label), (label, spelling)


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "email", "a@b.c"), (1, "person", "John  Smith"), (2, "person", "Ann Lee")], "doc_id int, category string, value string")
    got = spark.createDataFrame([(1, "email", "A@b.c"), (1, "person", "john smith jr"), (1, "person", "Bob"), (2, "phone", "12")], "doc_id int, category string, text string")
    rows = {r.category: (r.truths, r.covered, r.detections, r.right, r.sensitivity, r.precision, r.missed) for r in redact.evaluated(truth, got, "doc_id").collect()}
    assert rows["person"] == (2, 1, 2, 1, 0.5, 0.5, ["Ann Lee"]) and rows["phone"] == (0, 0, 1, 0, None, 0.0, None) and rows[None][:4] == (3, 2, 4, 2)


@pytest.mark.parametrize("terms,want", [(["ana", "ANA ", "", "ana"], [("ANA", 0, 3), ("ANA", 4, 7), ("ana", 0, 3), ("ana", 4, 7)]), ([], [])])
def test_terms(spark, terms, want):
    df = spark.createDataFrame([(1, "Ana anamnesis"), (2, None)], "doc_id int, text string")
    got = search.term_hits(df, terms, ["doc_id"]).collect()
    assert sorted((r.term, r.start, r.end) for r in got) == want
