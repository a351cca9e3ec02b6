"""Registered queries over texts made from the tables' keys, where what must be found is known; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velar.functions.dates import EN_MONTHS, ES_MONTHS, shift_date
from velar.functions.language import document_language
from velar.operators import detect, geometry, layers, redact, search
from velar.plans import samples
from velar.plans.catalog import PROFILES, matching_profile
from velar.sinks import ooxml as sink
from velar.sinks import results
from velar.sources import ooxml
from velar.sources.tables import scratch, written
from velar.streaming import documents

FEW = ["email", "phone", "es_national_id", "iban"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(texts: DataFrame, **options) -> DataFrame:
    return detect.detections(texts.withColumnRenamed("language", "of_doc"), ["key", "block"], language_col="of_doc", **options)


def _hundredths() -> Column:
    return F.round(F.col("score") * 100).cast("int").alias("score")


def find_spanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every recognizer of the Spanish engine finds in a text of its own, for each customer."""
    found = _found(samples.texts(_table(spark, sf_dir, "customer"), "c_custkey", "es"))
    return found.select("key", "block", "detector", "category", _hundredths(), F.col("text").alias("value"))


def find_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every recognizer of the English engine finds in a text of its own, for each customer."""
    found = _found(samples.texts(_table(spark, sf_dir, "customer"), "c_custkey", "en"))
    return found.select("key", "block", "detector", "category", _hundredths(), F.col("text").alias("value"))


def find_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in further forms of labels and values of both languages, and in texts that only look like data."""
    tables = [_found(samples.texts(_table(spark, sf_dir, "customer"), "c_custkey", f"{k} forms")) for k in ("es", "en")]
    return tables[0].unionByName(tables[1]).select("key", "block", "language", "detector", "category", _hundredths(), F.col("text").alias("value"))


def _expected(table: str, key: str, language: str) -> str:
    return f"SELECT key, block, detector, category, score, value FROM ({samples.expected_sql(table, key, language)})"


def detect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of documents of many blocks, numbered within each: the document's first blocks decide its language.

    A supplier has a Spanish document (even id) and an English one.
    """
    suppliers = _table(spark, sf_dir, "supplier")
    es, en = (samples.texts(suppliers, "s_suppkey", k).select((F.col("key") * 2 + i).alias("key"), "block", "text") for i, k in enumerate(("es", "en")))
    blocks = es.unionByName(en)
    languages = document_language(blocks, "key", "block")
    found = _found(blocks.join(languages, "key"))
    return redact.numbered(found, "key", "block").select("key", "det_id", "block", "language", "category", F.col("text").alias("value"))


_BLOCKS = """SELECT key, 'd' || (row_number() OVER (PARTITION BY key ORDER BY block, place) - 1) AS det_id, block, language, category, value FROM (
  SELECT key * 2 AS key, block, place, 'es' AS language, category, value FROM ({}) UNION ALL SELECT key * 2 + 1, block, place, 'en', category, value FROM ({}))"""


def redact_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each customer's Spanish document, of which two detections in three are approved by number."""
    blocks = samples.texts(_table(spark, sf_dir, "customer"), "c_custkey", "es").withColumnRenamed("language", "of_doc")
    found = written(detect.with_spans(blocks, categories=FEW, language_col="of_doc").select("key", "block", "text", "language", "spans"))  # read twice below
    numbers = redact.with_ids(found, "key", "block").select("key", F.explode(F.sequence(F.col("first_id"), F.col("first_id") + F.size("spans") - 1)).alias("n"), F.size("spans").alias("s")).where("s > 0")
    yes = numbers.where("n % 3 != key % 3").select("key", F.concat(F.lit("d"), F.col("n")).alias("det_id"))
    kept = redact.with_approved_spans(found, yes, "key", "block")
    return redact.redacted(kept).select("key", "block", "redacted", "edits")


def _redact_approved_sql() -> str:
    parts, n = [], 0
    for i, t in enumerate(samples.SPANISH):
        if t.category in FEW:
            before, after = t.sentence.split("{}")
            parts.append(
                f"SELECT k AS key, {i} AS block, '{before}' || CASE WHEN {n} % 3 <> k % 3 THEN repeat('█', CAST(greatest(4, length({t.value})) AS INT)) ELSE {t.value} END || '{after}' AS redacted, CAST({n} % 3 <> k % 3 AS INT) AS edits FROM t"
            )
            n += 1
        else:
            parts.append(f"SELECT k AS key, {i} AS block, {t.text()} AS redacted, 0 AS edits FROM t")
    return "WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) " + " UNION ALL ".join(parts)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a text with one address twice and another once; what is approved depends on the key."""
    one, two = F.concat(F.lit("Ana"), F.col("c_custkey"), F.lit("@example.org")), F.concat(F.lit("lee"), F.col("c_custkey"), F.lit("@example.org"))
    text = F.concat(F.lit("escribir a "), one, F.lit(", copia a "), one, F.lit(" y a "), two, F.lit(" sin falta"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), F.lit(0).alias("block_id"), text.alias("text"), F.lit("es").alias("of_doc"))


def _two_passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The redacted letters, their detections with numbers, approvals, and detections of the redacted letters.

    Even keys leave the second detection in place; the redacted texts are written before they are looked at again.
    """
    found = written(detect.with_spans(_letters(spark, sf_dir), categories=["email"], language_col="of_doc"))
    every = redact.numbered(detect.exploded(found, ["key", "block_id"]), "key", "block_id")
    yes = every.where("det_id != 'd1' or key % 2 = 1").select("key", "det_id")
    done = written(redact.redacted(redact.with_approved_spans(found, yes, "key", "block_id")).select("key", "block_id", "redacted", "of_doc"))
    again = detect.detections(done.withColumnRenamed("redacted", "text"), ["key", "block_id"], categories=["email"], language_col="of_doc")
    return done, every, yes, again


def leftovers_of_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved texts that a letter still holds, because the same text stands elsewhere and wasn't approved there."""
    done, every, yes, _ = _two_passes(spark, sf_dir)
    texts = redact.approved(every, yes, ["key", "det_id"]).select("key", "text")
    return redact.leftovers(done, texts, "key", "block_id").select("key", F.col("text").alias("value"))


def residuals_of_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second detection finds in the redacted letters, without texts that every fourth customer rejected."""
    _, every, yes, again = _two_passes(spark, sf_dir)
    rejected = every.join(yes, ["key", "det_id"], "left_anti").where("key % 4 = 0").select("key", "text")
    return redact.residuals(again, rejected, "key").select("key", "category", F.col("text").alias("value"))


_ADDRESS = "'Ana' || CAST(c_custkey AS STRING) || '@example.org'"
_MASKS = "repeat('█', length(a))"


def audit_of_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit record of each letter, flat: counts, never values, and the hash of what came out."""
    done, every, yes, again = _two_passes(spark, sf_dir)
    texts = redact.approved(every, yes, ["key", "det_id"]).select("key", "text")
    left = redact.leftovers(done, texts, "key", "block_id")
    none = every.where("false").select("key", "text")
    results = done.select("key", F.col("redacted").alias("content"), (F.col("key") % 3).alias("zones"))
    records = redact.audit_records(results, every, yes, left, redact.residuals(again, none, "key"), "key", ["email"], terms=2)
    r, s = F.col("record.redaction"), F.col("record.second_pass")
    by = F.element_at(r["by_category"], "email")
    return records.select(
        "key", r["total"].alias("total"), r["approved"].alias("approved"), r["rejected"].alias("rejected"), by["detected"].alias("emails"), by["redacted"].alias("emails_redacted"),
        s["leftovers"].alias("leftovers"), s["residuals"].alias("residuals"), F.col("record.sha256").alias("sha256"),
    )


_AUDIT_OF_LETTERS = f"""SELECT key, 2 + e + key % 3 + 2 AS total, 2 + e AS approved, 1 - e AS rejected, 3 AS emails, 2 + e AS emails_redacted, 1 - e AS leftovers, 1 - e AS residuals,
  sha256('escribir a ' || {_MASKS} || ', copia a ' || CASE WHEN e = 1 THEN {_MASKS} ELSE a END || ' y a ' || repeat('█', length(b)) || ' sin falta') AS sha256
FROM (SELECT CAST(c_custkey AS BIGINT) AS key, c_custkey % 2 AS e, {_ADDRESS} AS a, 'lee' || CAST(c_custkey AS STRING) || '@example.org' AS b FROM customer)"""


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second detection still finds in documents with everything blocked out, and approved texts still there."""
    found = detect.with_spans(_table(spark, sf_dir, "documents"))
    done = written(redact.redacted(found).select("doc_id", F.lit(0).alias("block_id"), "redacted", "text", "spans", "language"))
    again = detect.detections(done.select("doc_id", "block_id", F.col("redacted").alias("text"), F.col("language").alias("of_doc")), ["doc_id", "block_id"], language_col="of_doc")
    value = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    texts = done.select("doc_id", F.explode(F.transform("spans", value)).alias("text"))
    left = redact.leftovers(done, texts, "doc_id").select("doc_id", F.lit("leftover").alias("kind"), "text")
    more = redact.residuals(again, texts.where("false"), "doc_id").select("doc_id", F.lit("residual").alias("kind"), "text")
    return left.unionByName(more)


def audit_all_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of every category in the customers' Spanish texts, and how many stand in even blocks, whose are approved."""
    found = written(_found(samples.texts(_table(spark, sf_dir, "customer"), "c_custkey", "es")))  # read twice below
    return redact.audit(found, found.where("block % 2 = 0"), ["key", "block", "start", "category"])


def detect_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that each end with a sentence of personal data, another one for each turn: what is found.

    A line of signs stands between, as many as the tokens that may raise a score: only the sentence's own words do.
    """
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("text").alias("said"))
    made = samples.texts(turns, "key", "es", keep=("said",)).where(F.col("block") == F.col("key") % len(samples.SPANISH))
    line = F.lit(" ".join("*" * detect.NEAR_TOKENS))
    found = _found(made.withColumn("text", F.concat_ws("\n", "said", line, "text")).drop("said"))
    return found.select("key", "block", "detector", "category", _hundredths(), F.col("text").alias("value"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers in long texts, with what stands around them, cut at words."""
    far = F.repeat(F.lit("palabra "), 20)
    k = F.col("c_custkey").cast("string")
    text = F.concat(far, F.repeat(F.lit("x"), (F.col("c_custkey") % 9).cast("int")), F.lit(" escribir a u."), k, F.lit("@correo.example.org, gracias "), far)
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).alias("block"), text.alias("text"), F.lit("es").alias("language"))
    return _found(docs, categories=["email"]).select("key", "start", "end", "context")


_CONTEXTS = r"""WITH t AS (SELECT c_custkey AS key, repeat('palabra ', 20) || repeat('x', CAST(c_custkey % 9 AS INT)) || ' escribir a ' AS a, 'u.' || c_custkey || '@correo.example.org' AS v, ', gracias ' || repeat('palabra ', 20) AS b FROM customer)
SELECT key, CAST(length(a) AS INT) AS start, CAST(length(a) + length(v) AS INT) AS "end",
  '…' || regexp_replace(right(a, 70), '^\S*\s', '') || v || regexp_replace(left(b, 70), '\s\S*$', '') || '…' AS context FROM t"""


def results_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without their addresses, written with their audits under generic names: what stands in the folder then."""
    files = written(samples.office_files(_table(spark, sf_dir, "supplier"), "s_suppkey"))
    found = written(detect.with_spans(_shown(files).withColumn("of_doc", F.lit("es")), categories=["email"], language_col="of_doc").select("path", "block_id", "text", "spans", "language"))
    edits = found.select("path", "block_id", redact.edits_of(F.col("spans"), F.col("text"), F.col("language"), F.lit(0)).alias("edits")).where("size(edits) > 0")
    audits = found.groupBy("path").agg(F.sum(F.size("spans")).alias("addresses"))
    folder = scratch(spark)
    results.write_results(sink.redacted_files(files, edits).select("path", "content", "error"), folder, audits)
    kept = results.stored(spark, folder)
    name = F.element_at(F.split("name", "/"), -1)
    record = F.when(name == results.AUDIT, F.col("content").cast("string"))
    return kept.select(name.alias("file"), record.alias("record")).groupBy("file", "record").agg(F.count(F.lit(1)).alias("n"))


_RESULTS = """SELECT * FROM (VALUES ('redacted.docx', NULL), ('redacted.xlsx', NULL), ('audit.json', '{"addresses":3}'), ('audit.json', '{"addresses":2}')) AS t(file, record), (SELECT count(*) AS n FROM supplier)"""


def evaluate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and precision by category and for all, against what the suppliers' texts hold; with the first misses.

    Every first block is also said to hold a place by name, which no recognizer knows.
    """
    blocks = samples.texts(_table(spark, sf_dir, "supplier"), "s_suppkey", "es")
    each = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(c).alias("category"), F.expr(v).alias("value")) for i, t in enumerate(samples.SPANISH) for _, c, _, v in t.expected()])
    keys = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    number = (F.col("k") * samples.PER_KEY + F.col("t.b")).alias("doc")
    truth = keys.select("k", F.explode(each).alias("t")).select(number, "t.category", "t.value")
    place = keys.select((F.col("k") * samples.PER_KEY).alias("doc"), F.lit("place_or_postcode").alias("category"), F.concat(F.lit("Villa "), F.lpad(F.col("k").cast("string"), 6, "0")).alias("value"))
    found = _found(blocks).select((F.col("key") * samples.PER_KEY + F.col("block")).alias("doc"), "category", "text")
    rows = redact.evaluated(truth.unionByName(place), found, "doc")
    rate = lambda c: F.round(F.col(c) * 1000).cast("int").alias(c)
    return rows.select("category", "truths", "covered", "detections", "right", rate("sensitivity"), rate("precision"), F.array_join("missed", "|").alias("missed"))


def _evaluate_sql() -> str:
    counts: dict[str, int] = {}
    for t in samples.SPANISH:
        for _, c, _, _ in t.expected():
            counts[c] = counts.get(c, 0) + 1
    rows = [f"SELECT '{c}' AS category, {n} AS n, {int(c == 'place_or_postcode')} AS lost" for c, n in counts.items()] + [f"SELECT NULL, {sum(counts.values())}, 1"]
    return f"""SELECT category, (n + lost) * s AS truths, n * s AS covered, n * s AS detections, n * s AS right, CAST(round(1000.0 * n / (n + lost)) AS INT) AS sensitivity, 1000 AS precision,
  CASE WHEN category = 'place_or_postcode' THEN m END AS missed
FROM ({" UNION ALL ".join(rows)}) c, (SELECT count(*) AS s FROM supplier) x,
  (SELECT string_agg(v, '|' ORDER BY v) AS m FROM (SELECT 'Villa ' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS v FROM supplier ORDER BY v LIMIT 3)) y"""


def evaluate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and precision, in thousandths, by category and for all, over a clinical report for each customer.

    Of its seventeen values the name of a place needs a model of named entities.
    """
    made = written(samples.reports(_table(spark, sf_dir, "customer"), "c_custkey"))
    truth = made.select("doc", F.explode("truth").alias("t")).select("doc", "t.category", "t.value")
    rows = redact.evaluated(truth, detect.detections(made.select("doc", "text"), ["doc"]), "doc")
    rate = lambda c: F.round(F.col(c) * 1000).cast("int").alias(c)
    return rows.select("category", "truths", "covered", "detections", "right", rate("sensitivity"), rate("precision"))


_REPORTS = f"""SELECT category, CAST(sum(t) AS BIGINT) AS truths, CAST(sum(c) AS BIGINT) AS covered, CAST(sum(c) AS BIGINT) AS detections, CAST(sum(c) AS BIGINT) AS right,
  CAST(round(1000.0 * sum(c) / sum(t)) AS INT) AS sensitivity, CASE WHEN sum(c) > 0 THEN 1000 END AS precision
FROM (SELECT category, (SELECT count(*) FROM customer) AS t, CASE WHEN category = 'place_or_postcode' THEN 0 ELSE (SELECT count(*) FROM customer) END AS c FROM (VALUES {", ".join(f"('{c}')" for _, c, _ in samples.REPORT)}) v(category))
GROUP BY ROLLUP (category)"""


def allowed_and_own_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with terms of one's own, and without texts that are allowed: every customer with an even key asks alike."""
    text = F.concat(F.lit("proyecto Alfa"), F.col("c_custkey") % 7, F.lit(" con Alfa1 y alfa2, escribir a u"), F.col("c_custkey") % 5, F.lit("@x.org"))
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), F.lit(0).alias("block"), text.alias("text"), F.lit("es").alias("language"))
    found = _found(docs, categories=["email", "custom_term"], custom=["ALFA1", " alfa2 ", ""], allow=["U3@X.ORG", "Alfa2"])
    return found.select("key", "category", F.col("start").alias("span_start"), F.col("text").alias("value"))


_OWN_TERMS = """WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS key, c_custkey % 7 AS a, c_custkey % 5 AS u FROM customer)
SELECT key, 'custom_term' AS category, CAST(9 AS INT) AS span_start, 'Alfa1' AS value FROM t WHERE a = 1
UNION ALL SELECT key, 'custom_term', 19, 'Alfa1' FROM t
UNION ALL SELECT key, 'email', 45, 'u' || CAST(u AS STRING) || '@x.org' FROM t WHERE u <> 3"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a language model's replies to each customer's text: only what stands there, whole words, of known kinds."""
    text = F.concat(F.lit("Ana vino con Anabel y ana"), F.col("c_custkey"), F.lit(". Doctor Ruiz, ana; Cuba"))
    reply = F.concat(F.lit('<think>{"no": 1}</think>Here: ```json\n{"entidades": [{"texto": " ANA ", "tipo": "Paciente"}, {"texto": "Cu}ba", "tipo": "lugar"}, {"texto": "Cuba", "tipo": "lugar"}, {"texto": "ru", "tipo": "medico"}, {"texto": "ruiz", "tipo": "'), F.when(F.col("c_custkey") % 2 == 0, "medico").otherwise("planet"), F.lit('"}, 7]} ``` done'))
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), text.alias("text"), reply.alias("reply"))
    found = layers.proposed(t.select("key", "text"), t.select("key", "reply"), ["key"])
    spans = found.select("key", "text", F.explode("proposed").alias("s"))
    return spans.select("key", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.category", F.col("s.layer").alias("layer"), F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


_PROPOSALS = """WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS key, CAST(length(CAST(c_custkey AS STRING)) AS INT) AS n FROM customer)
SELECT key, 0 AS span_start, 3 AS span_end, 'person' AS category, 3 AS layer, 'Ana' AS value FROM t
UNION ALL SELECT key, n + 40, n + 43, 'person', 3, 'ana' FROM t
UNION ALL SELECT key, n + 45, n + 49, 'place_or_postcode', 3, 'Cuba' FROM t
UNION ALL SELECT key, n + 34, n + 38, 'clinician', 3, 'Ruiz' FROM t WHERE key % 2 = 0"""


def profiles_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named set that each customer's categories are; half of them miss one of a set's, and so have none."""
    sets = F.array(*[F.split(F.lit(" ".join(c)), " ") for c in PROFILES.values()])
    chosen = F.get(sets, (F.col("c_custkey") % len(PROFILES)).cast("int"))
    some = F.when(F.col("c_custkey") % (2 * len(PROFILES)) < len(PROFILES), chosen).otherwise(F.slice(chosen, F.lit(2), F.size(chosen)))
    active = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), F.explode(some).alias("category"))
    return matching_profile(active, "key")


_PROFILES = f"""SELECT CAST(c_custkey AS BIGINT) AS key, CASE WHEN c_custkey % {2 * len(PROFILES)} < {len(PROFILES)} THEN CASE c_custkey % {len(PROFILES)} {" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROFILES))} END END AS profile FROM customer"""


def shift_long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in words of both languages, with two-digit years and as months, moved by 30 to 180 days by order key."""
    o = _table(spark, sf_dir, "orders").withColumn("d", (F.col("o_orderkey") % 151 + 30).cast("int"))
    at = F.col("o_orderdate")
    es_month, en_month = (F.get(F.array(*[F.lit(m) for m in names]), F.month(at) - 1) for names in (ES_MONTHS, EN_MONTHS))
    day, year = F.dayofmonth(at).cast("string"), F.year(at).cast("string")
    shown = {
        "es_day": ("es", F.concat_ws(" de ", day, es_month, year)), "es_month": ("es", F.concat(es_month, F.lit(" del "), year)), "es_short": ("es", F.date_format(at, "d-M-yy")),
        "en_day": ("en", F.concat(day, F.lit("th of "), en_month, F.lit(" "), year)), "en_month": ("en", F.concat(F.substring(en_month, 1, 3), F.lit(". "), year)), "en_number": ("en", F.date_format(at, "MM/dd/yyyy")),
    }
    return o.select("o_orderkey", *[shift_date(t, F.col("d"), F.lit(k)).alias(n) for n, (k, t) in shown.items()])


_LONG_DATES = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderkey % 151 + 30 AS INT) AS d FROM orders),
m AS (SELECT o_orderkey, a, a + d AS b, CAST(date_trunc('month', a) AS DATE) + 14 + d AS c, {ES_MONTHS} AS es FROM o)
SELECT o_orderkey, CAST(day(b) AS STRING) || ' de ' || es[month(b)] || ' de ' || CAST(year(b) AS STRING) AS es_day, es[month(c)] || ' de ' || CAST(year(c) AS STRING) AS es_month,
  strftime(b, '%d-%m-%y') AS es_short, strftime(b, '%-d %B %Y') AS en_day, CASE WHEN month(a) = 5 THEN strftime(c, '%B %Y') ELSE strftime(c, '%b %Y') END AS en_month,
  CASE WHEN day(a) > 12 THEN strftime(b, '%m/%d/%Y') END AS en_number FROM m"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts' names as words of pages: each word's place in its page's text, and the text."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.posexplode(F.split("p_name", " ")).alias("word_no", "word"))
    joined = geometry.page_words(p, ["page"]).join(geometry.page_texts(p, ["page"]), "page")
    return joined.select("page", "word_no", F.col("start").alias("word_start"), F.col("end").alias("word_end"), "text", "n_words")


_PAGE_TEXTS = """SELECT page, CAST(i - 1 AS INT) AS word_no, CAST(e - length(w[i]) AS INT) AS word_start, CAST(e AS INT) AS word_end, p_name AS text, CAST(len(w) AS INT) AS n_words
FROM (SELECT *, list_sum(list_transform(w[:i], lambda x: length(x) + 1)) - 1 AS e FROM (
  SELECT p_partkey AS page, p_name, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part))"""


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages of 100 by 200 points whose text is as long as a price; order lines as images on them."""
    key = F.col("o_orderkey")
    pages = _table(spark, sf_dir, "orders").select(key.alias("page"), F.col("o_custkey").alias("doc"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), F.repeat(F.lit("x"), (key * 37 % 900).cast("int")).alias("text"), (key % 10 == 0).alias("by_ocr"))
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    images = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0.0).alias("x0"), (n * 24).alias("y0"), (q * 2).alias("x1"), (n * 24 + q * 3).alias("y1"))
    return pages, images


def pages_for_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: the share of their largest image, whether they need OCR, whether their document has text."""
    pages, images = _pages(spark, sf_dir)
    covered = geometry.image_cover(pages, images, ["page"]).join(geometry.has_text(pages, "doc"), "doc")
    return covered.select("page", F.round(F.col("cover") * 10000).cast("int").alias("cover"), geometry.needs_ocr(F.col("text"), F.col("cover")).alias("needs_ocr"), "has_text")


_PAGES = """WITH p AS (SELECT o_orderkey AS page, o_custkey AS doc, o_orderkey * 37 % 900 AS n FROM orders),
c AS (SELECT l_orderkey AS page, max(CAST(l_quantity AS DOUBLE) * 2 * CAST(l_quantity AS DOUBLE) * 3) / 20000 AS c FROM lineitem GROUP BY l_orderkey),
d AS (SELECT doc, sum(n) >= 20 AS has_text FROM p GROUP BY doc),
x AS (SELECT p.*, least(coalesce(c, 0), 1.0) AS cover FROM p LEFT JOIN c ON p.page = c.page)
SELECT page, CAST(round(cover * 10000) AS INT) AS cover, n < 15 OR (cover > 0.55 AND n < 600) AS needs_ocr, has_text FROM x JOIN d ON x.doc = d.doc"""


def letterheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as images: those in the head or foot of their page."""
    found = geometry.letterheads(*_pages(spark, sf_dir), ["page"])
    return found.select("page", F.col("y0").cast("int").alias("y0"), F.col("y1").cast("int").alias("y1"), "category")


_LETTERHEADS = """SELECT page, CAST(y0 AS INT) AS y0, CAST(y1 AS INT) AS y1, 'logo' AS category FROM (
  SELECT l_orderkey AS page, l_linenumber * 24.0 AS y0, l_linenumber * 24.0 + CAST(l_quantity AS DOUBLE) * 3 AS y1, CAST(l_quantity AS DOUBLE) * 2 * CAST(l_quantity AS DOUBLE) * 3 / 20000 AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0)
WHERE ((y0 + y1) / 2 / 200 <= 0.2 OR (y0 + y1) / 2 / 200 >= 0.88) AND share <= 0.55"""


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words that OCR read, with twice the quantity as confidence: the sure ones, in points."""
    q = F.col("l_quantity").cast("double")
    words = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 2).alias("conf"), F.col("l_returnflag").alias("word"), *[(F.col("l_linenumber") * i * 110).cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return geometry.recognised_words(words).select("l_orderkey", "l_linenumber", *[F.round(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


_RECOGNISED = """SELECT l_orderkey, l_linenumber, 0 AS x0, CAST(round(l_linenumber * 110 * 72 / 220.0) AS INT) AS y0, CAST(round(l_linenumber * 220 * 72 / 220.0) AS INT) AS x1, CAST(round(l_linenumber * 330 * 72 / 220.0) AS INT) AS y1
FROM lineitem WHERE l_quantity * 2 >= 40"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words of a page for each order, at places from their keys."""
    x, y = F.col("l_partkey") * 37 % 90, F.col("l_suppkey") * 13 % 60
    cols = {"x0": x, "y0": y, "x1": x + 5, "y1": y + 4 + F.col("l_partkey") % 5}
    words = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("word"), *[c.cast("double").alias(k) for k, c in cols.items()])
    return words


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at places from keys in the order of reading, by lines, and by columns and lines."""
    plain = geometry.reading_order(_boxes(spark, sf_dir), ["page"]).select("page", "word", "line", "word_no")
    both = geometry.reading_order(_boxes(spark, sf_dir), ["page"], gutter=10).select("page", "word", F.col("column").alias("in_column"), F.col("line").alias("in_line"), F.col("word_no").alias("in_order"))
    return plain.join(both, ["page", "word"])


_BOXES = """w AS (SELECT l_orderkey AS page, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS word, CAST(l_partkey * 37 % 90 AS DOUBLE) AS x0, CAST(l_suppkey * 13 % 60 AS DOUBLE) AS y0,
  CAST(l_partkey * 37 % 90 + 5 AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 60 + 4 + l_partkey % 5 AS DOUBLE) AS y1 FROM lineitem)"""


def _islands_sql(name: str, source: str, by: str, first: str, reach: str, begins: str, out: str) -> str:
    order = f"PARTITION BY {by} ORDER BY {first}, {reach}, x0, x1, word"
    return f"""{name}_b AS (SELECT *, max({reach}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {source}),
{name} AS (SELECT * EXCLUDE (reached), CAST(sum(CASE WHEN reached IS NOT NULL AND {begins} THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS INT) AS {out} FROM {name}_b)"""


_LINES = f"""WITH {_BOXES},
{_islands_sql("p", "w", "page", "y0", "y1", "(y0 + y1) / 2 >= reached", "line")},
{_islands_sql("c", "w", "page", "x0", "x1", "x0 > reached + 10", "in_column")},
{_islands_sql("q", "c", "page, in_column", "y0", "y1", "(y0 + y1) / 2 >= reached", "in_line")}
SELECT p.page, p.word, p.line, CAST(row_number() OVER (PARTITION BY p.page ORDER BY p.line, p.x0, p.x1, p.y0, p.y1, p.word) - 1 AS INT) AS word_no, in_column, in_line,
  CAST(row_number() OVER (PARTITION BY p.page ORDER BY in_column, in_line, p.x0, p.x1, p.y0, p.y1, p.word) - 1 AS INT) AS in_order
FROM p JOIN q ON p.page = q.page AND p.word = q.word"""


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages turned by quarters, of which every third is read by OCR: its words, turned back, in place of the page's."""
    pages = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), (F.col("o_custkey") % 4 * 90).cast("int").alias("rotation"), (F.col("o_orderkey") % 3 == 0).alias("needs_ocr"))
    x = lambda n: (F.col("l_linenumber") * 22 + n).cast("double")
    read = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("ocr-"), F.col("l_linenumber")).alias("word"), (F.col("l_quantity").cast("double") * 2).alias("conf"), x(0).alias("x0"), x(2).alias("y0"), x(11).alias("x1"), x(13).alias("y1"))
    found = geometry.with_recognised(_boxes(spark, sf_dir), pages, read, ["page"], dpi=144)
    return found.select("page", "word", "by_ocr", *[F.round(F.col(c) * 10).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


_READ = f"""WITH {_BOXES}, g AS (SELECT o_orderkey AS page, o_custkey % 4 AS turn, o_orderkey % 3 = 0 AS ocr FROM orders),
s AS (SELECT l_orderkey AS page, 'ocr-' || l_linenumber AS word, turn, l_linenumber * 11.0 AS a, l_linenumber * 11.0 + 1 AS b, l_linenumber * 11.0 + 5.5 AS c, l_linenumber * 11.0 + 6.5 AS d
  FROM lineitem JOIN g ON l_orderkey = page WHERE ocr AND l_quantity * 2 >= 40),
u AS (SELECT page, word, true AS by_ocr, CASE turn WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN 100 - c ELSE 100 - d END AS x0, CASE turn WHEN 0 THEN b WHEN 1 THEN 200 - c WHEN 2 THEN 200 - d ELSE a END AS y0,
  CASE turn WHEN 0 THEN c WHEN 1 THEN d WHEN 2 THEN 100 - a ELSE 100 - b END AS x1, CASE turn WHEN 0 THEN d WHEN 1 THEN 200 - a WHEN 2 THEN 200 - b ELSE c END AS y1 FROM s
  UNION ALL SELECT page, word, false, x0, y0, x1, y1 FROM w WHERE page NOT IN (SELECT page FROM g WHERE ocr))
SELECT page, word, by_ocr, CAST(round(x0 * 10) AS INT) AS x0, CAST(round(y0 * 10) AS INT) AS y0, CAST(round(x1 * 10) AS INT) AS x1, CAST(round(y1 * 10) AS INT) AS y1 FROM u"""


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of eight letters or more of the benchmark stands in each document, inside words as well: a table of terms."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]{8,}"), F.lit(0))
    terms = _table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term"))
    found = search.term_hits(_table(spark, sf_dir, "documents"), terms, ["doc_id"])
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCHMARK_TERMS = f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all({_SMALL}, '[a-z]{{8,}}')) AS term FROM benchmark),
d AS (SELECT doc_id, {_SMALL} AS x FROM documents)
SELECT doc_id, term, CAST((length(x) - length(replace(x, term, ''))) / length(term) AS BIGINT) AS n FROM d JOIN t ON contains(x, term)"""


def held_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts of their user's document, through a stream: how long each is held, and the shift it keeps meanwhile."""
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    puts = events.select(F.col("user_id").alias("doc"), F.col("ts").cast("timestamp").alias("at"), F.lit("put").alias("action"), (F.col("event_id") % 151 + 30).cast("int").alias("days"))
    name, store = documents.STORE
    before, path = spark.conf.get(name), scratch(spark)
    spark.conf.set(name, store)
    try:
        held = documents.held_documents(puts, minutes=30)
        held.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c) for c in ("at", "opened")]
    return spark.read.parquet(f"{path}/rows").select("doc", "event", *shown, "days")


_HELD = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CAST(event_id % 151 + 30 AS INT) AS days FROM events),
p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS before FROM e),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before >= 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM p),
g AS (SELECT user_id, n, min(t) AS opened, max(t) + 1800000 AS goes, arg_min(days, t) AS days FROM s GROUP BY user_id, n),
r AS (SELECT s.user_id, 'put' AS event, t AS moment, opened, g.days FROM s JOIN g ON s.user_id = g.user_id AND s.n = g.n
  UNION ALL SELECT user_id, 'expired', goes, opened, days FROM g WHERE goes <= (SELECT max(t) FROM e))
SELECT CAST(user_id AS VARCHAR) AS doc, event, strftime(make_timestamp(moment * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at, strftime(make_timestamp(opened * 1000), '%Y-%m-%d %H:%M:%S.%g') AS opened, days FROM r"""


def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of each order's span over its lines' boxes: a replacement stays only where there is a single one."""
    w = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), ((F.col("l_linenumber") - 1) * 10).alias("start"), ((F.col("l_linenumber") - 1) * 10 + 9).alias("end"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("line"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
    )
    s = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("span_id"), (F.col("o_orderkey") % 30).cast("int").alias("start"), (F.col("o_orderkey") % 30 + 15).cast("int").alias("end"), F.lit("new").alias("replacement"))
    return geometry.page_edits(s, geometry.span_rectangles(s, w, ["doc"]), ["doc"]).select("doc", "line", "replacement")


_EDITS = """WITH r AS (SELECT DISTINCT o_orderkey AS doc, CAST((l_linenumber - 1) // 3 AS INT) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE (l_linenumber - 1) * 10 < o_orderkey % 30 + 15 AND (l_linenumber - 1) * 10 + 9 > o_orderkey % 30)
SELECT doc, line, CASE WHEN count(*) OVER (PARTITION BY doc) = 1 THEN 'new' END AS replacement FROM r"""


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cells show: order dates, with a time for odd keys, order keys padded by a format of zeros, and prices."""
    o = _table(spark, sf_dir, "orders")
    at = F.date_format(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate").cast("date").cast("timestamp") + F.expr("INTERVAL 7 HOURS")).otherwise(F.col("o_orderdate").cast("date").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    cells = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), v.alias("value"), F.lit(f).alias("format")) for c, k, v, f in [
        ("date", "date", at, "dd/mm/yy"), ("time", "time", at, "h:mm"), ("padded", "number", F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")), "0000000000"), ("plain", "number", F.col("o_orderkey").cast("string"), "0.00"), ("text", "text", F.col("o_orderstatus"), None),
    ]])).alias("c"))
    return cells.select("o_orderkey", "c.col", search.visible_value(F.col("c.kind"), F.col("c.value"), F.col("c.format")).alias("shown"))


_CELL_VALUES = """WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE WHEN o_orderkey % 2 = 1 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END AS a FROM orders)
SELECT o_orderkey, 'date' AS col, CASE WHEN o_orderkey % 2 = 1 THEN strftime(a, '%d/%m/%Y %H:%M:%S') ELSE strftime(a, '%d/%m/%Y') END AS shown FROM o
UNION ALL SELECT o_orderkey, 'time', strftime(a, '%H:%M:%S') FROM o UNION ALL SELECT o_orderkey, 'padded', lpad(CAST(o_orderkey AS STRING), 10, '0') FROM o
UNION ALL SELECT o_orderkey, 'plain', CAST(o_orderkey AS STRING) FROM o UNION ALL SELECT o_orderkey, 'text', o_orderstatus FROM o"""


def clipped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in cells' texts cut to the cells' values: a span for each order from its key, behind a heading of six."""
    o = _table(spark, sf_dir, "orders").withColumn("value_start", F.lit(6)).withColumn("value_end", F.lit(16))
    start = (F.col("o_orderkey") % 20).cast("int")
    one = F.array(F.struct(start.alias("start"), (start + 4).alias("end")))
    return o.select("o_orderkey", F.explode(search.clipped(one, F.col("value_start"), F.col("value_end"))).alias("s")).select("o_orderkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


_CLIPPED = "SELECT o_orderkey, CAST(greatest(o_orderkey % 20, 6) AS INT) AS span_start, CAST(least(o_orderkey % 20 + 4, 16) AS INT) AS span_end FROM orders WHERE greatest(o_orderkey % 20, 6) < least(o_orderkey % 20 + 4, 16)"

def _shown(files: DataFrame) -> DataFrame:
    """Blocks of files with their visible texts, numbers of files as key."""
    found = ooxml.blocks(files)
    text = F.when(F.col("kind").isNull(), F.col("text")).otherwise(search.visible_value(F.col("kind"), F.col("text"), F.col("number_format")))
    return found.withColumn("text", text).withColumn("key", F.split("path", r"\.")[0].cast("bigint")).withColumn("file", F.split("path", r"\.")[1])


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, and cells with their context, of a Word and an Excel file for each supplier."""
    shown = written(_shown(samples.office_files(_table(spark, sf_dir, "supplier"), "s_suppkey")))
    cells = shown.where("origin = 'cell'").withColumnRenamed("text", "value")
    with_context = search.with_cell_context(cells, ["key", "sheet"])
    columns = ["key", "file", "block_id", "origin", "row", "col", "text", "hidden"]
    return shown.where("origin != 'cell'").select(*columns).unionByName(with_context.select(*columns))


_MAIL = "'u' || CAST(k AS STRING) || '@x.org'"
_CODE = "lpad(CAST(k AS STRING), 8, '0')"
_DATE = "strftime(DATE '1899-12-30' + CAST(45292 + k % 300 + {} AS INT), '%d/%m/%Y')"


def _file_rows(mail: str, context: bool) -> str:
    head = (lambda name, value: f"'{name}: ' || {value}") if context else (lambda name, value: value)
    word = [("body", f"'Escribir a ' || {mail} || ' & Cía'"), ("body", "'sin datos'"), ("body", f"'o a ' || {mail}"), ("header", f"'De ' || {mail}")]
    excel = [("title", 0, 0, "'Datos'")] + [("cell", 1, i + 1, (f"'{left}: ' || " if context and left else "") + f"'{t}'") for i, (t, left) in enumerate((("Correo", ""), ("Fecha", "Correo"), ("Clave", "Fecha")))]
    for i, t in enumerate((f"'a ' || {mail} || '!'", "'nada'")):
        excel += [("cell", i + 2, 1, head("Correo", t)), ("cell", i + 2, 2, head("Fecha", _DATE.format(i))), ("cell", i + 2, 3, head("Clave", _CODE))]
    excel.append(("footer", 1, 1, f"'por ' || {mail}"))
    rows = [f"SELECT k AS key, 'docx' AS file, {i} AS block_id, '{o}' AS origin, CAST(NULL AS INT) AS row, CAST(NULL AS INT) AS col, {t} AS text, CAST(NULL AS BOOLEAN) AS hidden FROM t" for i, (o, t) in enumerate(word)]
    rows += [f"SELECT k, 'xlsx', {i}, '{o}', {r}, {c}, {t}, false FROM t" for i, (o, r, c, t) in enumerate(excel)]
    return "WITH t AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) " + " UNION ALL ".join(rows)


def redact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with their e-mail addresses taken out, written and read again; and how many packages still hold one."""
    files = written(samples.office_files(_table(spark, sf_dir, "supplier"), "s_suppkey"))
    found = written(detect.with_spans(_shown(files).withColumn("of_doc", F.lit("es")), categories=["email"], language_col="of_doc").select("path", "block_id", "text", "spans", "language"))
    edits = found.select("path", "block_id", redact.edits_of(F.col("spans"), F.col("text"), F.col("language"), F.lit(0)).alias("edits")).where("size(edits) > 0")
    done = written(sink.redacted_files(files, edits))
    value = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    left = sink.package_leftovers(done, found.select("path", F.explode(value).alias("text")).distinct()).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    again = _shown(done.select("path", "content", "error")).join(left, "path", "left")
    return again.select("key", "file", "block_id", "origin", "row", "col", "text", "hidden", F.coalesce("n", F.lit(0)).cast("int").alias("left_in_package"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        find_spanish, find_english, find_forms, detect_turns, contexts, results_of_files, held_users, page_lines, pages_read, benchmark_terms, detect_blocks, redact_approved, leftovers_of_letters, residuals_of_letters, audit_of_letters, second_pass, audit_all_categories, evaluate_texts, evaluate_reports,
        allowed_and_own_terms, proposals, profiles_of_customers, shift_long_dates, page_texts, pages_for_ocr, letterheads, recognised_words, page_edits, cell_values, clipped_cells, read_files, redact_files,
    )
}

ORACLE_SQL: dict[str, str] = {
    "contexts": _CONTEXTS,
    "results_of_files": _RESULTS,
    "detect_turns": f"""SELECT key, block, detector, category, score, value FROM ({samples.expected_sql("(SELECT conv_id * 1000 + turn AS key FROM conversations)", "key", "es")}) WHERE block = key % {len(samples.SPANISH)}""",
    "held_users": _HELD,
    "page_lines": _LINES,
    "pages_read": _READ,
    "benchmark_terms": _BENCHMARK_TERMS,
    "find_forms": " UNION ALL ".join(f"SELECT key, block, '{k}' AS language, detector, category, score, value FROM ({samples.expected_sql('customer', 'c_custkey', f'{k} forms')})" for k in ("es", "en")),
    "find_spanish": _expected("customer", "c_custkey", "es"),
    "find_english": _expected("customer", "c_custkey", "en"),
    "detect_blocks": _BLOCKS.format(samples.expected_sql("supplier", "s_suppkey", "es"), samples.expected_sql("supplier", "s_suppkey", "en")),
    "redact_approved": _redact_approved_sql(),
    "leftovers_of_letters": f"SELECT CAST(c_custkey AS BIGINT) AS key, {_ADDRESS} AS value FROM customer WHERE c_custkey % 2 = 0",
    "residuals_of_letters": f"SELECT CAST(c_custkey AS BIGINT) AS key, 'email' AS category, {_ADDRESS} AS value FROM customer WHERE c_custkey % 4 = 2",
    "audit_of_letters": _AUDIT_OF_LETTERS,
    "audit_all_categories": f"SELECT category, count(*) AS detected, count(*) FILTER (WHERE block % 2 = 0) AS redacted FROM ({samples.expected_sql('customer', 'c_custkey', 'es')}) GROUP BY category",
    "evaluate_texts": _evaluate_sql(),
    "evaluate_reports": _REPORTS,
    "allowed_and_own_terms": _OWN_TERMS,
    "proposals": _PROPOSALS,
    "profiles_of_customers": _PROFILES,
    "shift_long_dates": _LONG_DATES,
    "page_texts": _PAGE_TEXTS,
    "pages_for_ocr": _PAGES,
    "letterheads": _LETTERHEADS,
    "recognised_words": _RECOGNISED,
    "page_edits": _EDITS,
    "cell_values": _CELL_VALUES,
    "clipped_cells": _CLIPPED,
    "read_files": f"SELECT key, file, block_id, origin, row, col, text, hidden FROM ({_file_rows(_MAIL, True)})",
    "redact_files": f"SELECT key, file, block_id, origin, row, col, text, hidden, 0 AS left_in_package FROM ({_file_rows(f'repeat({chr(39)}█{chr(39)}, length({_MAIL}))', False)})",
}
