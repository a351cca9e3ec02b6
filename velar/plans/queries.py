"""The registered queries of the detection engine, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velar.functions import checks
from velar.functions.dates import age_band, shift_date, shift_days
from velar.functions.language import EN_WORDS, ES_WORDS, detection_language, document_language
from velar.operators import detect, geometry, redact, search
from velar.plans import sample_queries
from velar.sources.tables import written

TERMS = ["Apache License", "the", "MIT"]


def job_secret(spark: SparkSession) -> str:
    """The secret of shifts, from spark.velar.secret; a session without one draws its own, kept nowhere else."""
    found = spark.conf.get("spark.velar.secret", None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set("spark.velar.secret", found)
    return found


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection of every category in documents; each text decides its language."""
    found = detect.detections(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "language", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", "score", "detector", "text")


def detect_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in conversations: a conversation is a document, which has one language; a turn is a block."""
    turns = _table(spark, sf_dir, "conversations")
    languages = document_language(turns, "conv_id", "turn").withColumnRenamed("language", "doc_language")
    found = detect.detections(turns.join(languages, "conv_id"), ["conv_id", "turn"], language_col="doc_language")
    return redact.numbered(found, "conv_id", "turn").select("conv_id", "turn", "det_id", "language", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", "text")


def _counted(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    found = detect.detections(_table(spark, sf_dir, "documents"), ["doc_id"], categories=[category])
    return found.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))


def detect_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each e-mail address of each document, and how often."""
    return _counted(spark, sf_dir, "email")


def detect_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payment card number of each document that passes its check, and how often."""
    return _counted(spark, sf_dir, "payment_card")


_PLAIN = r"translate(text, chr(13) || chr(10) || chr(9), '   ')"
_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]{2,}"
_BARE = "rtrim(ltrim(x, '.,;:-–—()[]+'), '.,;:-–—()[]')"
_EMAILS = rf"SELECT doc_id, {_BARE} AS text FROM (SELECT doc_id, unnest(regexp_extract_all({_PLAIN}, '{_EMAIL}')) AS x FROM documents)"
_CARDS = rf"""SELECT doc_id, m AS text FROM (
  SELECT doc_id, m, reverse(regexp_replace(m, '[\s-]', '', 'g')) AS r FROM (
    SELECT doc_id, unnest(regexp_extract_all({_PLAIN}, '\b[3-6]\d{{3}}(?:[\s-]?\d{{4}}){{2}}[\s-]?\d{{1,7}}\b')) AS m FROM documents))
  WHERE length(r) BETWEEN 13 AND 19 AND (SELECT sum(CASE WHEN i % 2 = 1 THEN CAST(r[i] AS INT)
    ELSE 2 * CAST(r[i] AS INT) - CASE WHEN CAST(r[i] AS INT) > 4 THEN 9 ELSE 0 END END) FROM range(1, 20) t(i) WHERE i <= length(r)) % 10 = 0"""
_COUNTED = "SELECT doc_id, text, count(*) AS n FROM ({}) GROUP BY doc_id, text"


def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection language of each document."""
    return _table(spark, sf_dir, "documents").select("doc_id", detection_language(F.col("text")).alias("language"))


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by detection language and labelled language."""
    docs = _table(spark, sf_dir, "documents").select("lang", detection_language(F.col("text")).alias("language"))
    return docs.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


_LANGUAGE = """SELECT doc_id, lang, CASE WHEN text IS NOT NULL AND len(list_filter(t, lambda x: list_contains({en}, x)))
  > (len(list_filter(t, lambda x: list_contains({es}, x))) + CASE WHEN regexp_matches(text, '[áéíóúñ¿¡]') THEN 3 ELSE 0 END) * 1.15
  THEN 'en' ELSE 'es' END AS language
FROM (SELECT doc_id, lang, text, list_slice(regexp_extract_all(lower(text), '[a-záéíóúñü]+'), 1, 4000) AS t FROM documents)""".format(en=EN_WORDS, es=ES_WORDS)


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with all detections approved: dates moved by its own shift, ages banded, the rest blocked."""
    found = detect.with_spans(_table(spark, sf_dir, "documents"))
    done = redact.redacted(found, shift_days(F.col("doc_id"), job_secret(spark)), dates="shift", ages="band")
    return done.select("doc_id", "language", F.size("spans").alias("n_spans"), "redacted")


def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, number of blocks and hash of each document after its e-mail addresses are blocked out."""
    found = detect.with_spans(_table(spark, sf_dir, "documents"), categories=["email"])
    done = redact.redacted(found)
    blocks = F.length("redacted") - F.length(F.replace("redacted", F.lit(redact.BLOCK), F.lit("")))
    return done.select("doc_id", F.length("redacted").alias("n_chars"), blocks.alias("n_blocks"), F.sha2(F.col("redacted").cast("binary"), 256).alias("sha256"))


_REDACTED = rf"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '{_EMAIL}') AS gaps, list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda x: {{'m': x, 't': {_BARE}}}) AS hits FROM documents),
p AS (SELECT doc_id, text, gaps, list_transform(hits, lambda h: substr(h.m, 1, strpos(h.m, h.t) - 1) || repeat('█', CAST(greatest(4, length(h.t)) AS INT)) || substr(h.m, strpos(h.m, h.t) + length(h.t))) AS masks,
  coalesce(list_sum(list_transform(hits, lambda h: length(h.t))), 0) AS n FROM m),
r AS (SELECT doc_id, n, text, CASE WHEN len(masks) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(masks[i], '')), '') END AS red FROM p)
SELECT doc_id, CAST(length(text) AS INT) AS n_chars, CAST(CASE WHEN text IS NOT NULL THEN n END AS INT) AS n_blocks, sha256(red) AS sha256 FROM r"""


def audit_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses and cards detected, and how many of them stand in English documents, whose are approved."""
    docs = _table(spark, sf_dir, "documents")
    found = written(detect.detections(docs, ["doc_id", "lang"], categories=["email", "payment_card"]))  # read twice below
    keys = ["doc_id", "start", "category"]
    return redact.audit(found, found.where("lang = 'en'"), keys)


_AUDIT = f"""SELECT category, count(*) AS detected, count(*) FILTER (WHERE lang = 'en') AS redacted FROM (
  SELECT doc_id, 'email' AS category FROM ({_EMAILS}) UNION ALL SELECT doc_id, 'payment_card' FROM ({_CARDS})) f
JOIN documents d ON f.doc_id = d.doc_id GROUP BY category"""


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of three literal terms stands in each document, in any letter case and inside words."""
    hits = search.term_hits(_table(spark, sf_dir, "documents"), TERMS, ["doc_id"])
    return hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


_TERMS = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS term, CAST((length(text) - length(replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t.lower()}', ''))) / {len(t)} AS BIGINT) AS n FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t.lower()}')"
    for t in TERMS
)


def _digits(key: str, size: int, factor: int, table: DataFrame) -> DataFrame:
    product = F.col(key).cast("decimal(19,0)") * F.lit(factor).cast("decimal(18,0)")  # larger than a bigint from some hundred thousand keys on
    rest = (product % F.lit(10**size).cast("decimal(19,0)")).cast("string")
    return table.select(F.col(key).alias("key"), F.lpad(rest, size, "0").alias("digits"))


def check_national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys as national ids, with the letter of the key or of the next one."""
    t = _digits("c_custkey", 8, 1, _table(spark, sf_dir, "customer"))
    letter = F.substring(F.lit(checks.ID_LETTERS), ((F.col("key") + F.col("key") % 2) % 23 + 1).cast("int"), F.lit(1))
    value = F.concat(F.col("digits"), F.lit("-"), letter)
    return t.select("key", value.alias("value"), checks.national_id(value).alias("valid"))


def check_social_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys as Spanish social security numbers."""
    t = _digits("c_custkey", 12, 7919 * 1009 * 97, _table(spark, sf_dir, "customer"))
    return t.select("key", "digits", checks.es_social_security(F.col("digits")).alias("valid"))


def check_nhs_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys as NHS numbers."""
    t = _digits("o_orderkey", 10, 104729, _table(spark, sf_dir, "orders"))
    return t.select("key", "digits", checks.uk_nhs(F.col("digits")).alias("valid"))


def check_tax_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys as SSN and ITIN."""
    t = _digits("o_orderkey", 9, 7368787, _table(spark, sf_dir, "orders"))
    return t.select("key", "digits", checks.us_ssn(F.col("digits")).alias("ssn"), checks.us_itin(F.col("digits")).alias("itin"))


def check_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' keys as card numbers."""
    t = _digits("p_partkey", 16, 1299709 * 15485863, _table(spark, sf_dir, "part"))
    return t.select("key", "digits", checks.payment_card(F.col("digits")).alias("valid"))


def check_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys as Spanish account numbers, with the right control for even keys."""
    t = _digits("c_custkey", 18, 104729 * 7919, _table(spark, sf_dir, "customer"))
    rest = (F.concat(F.col("digits"), F.lit("142800")).cast("decimal(38,0)") % 97).cast("int")
    control = F.lpad(((98 - rest + F.col("key") % 2) % 100).cast("string"), 2, "0")
    value = F.concat(F.lit("ES"), control, F.lit("00"), F.col("digits"))
    return t.select("key", value.alias("value"), checks.iban(value).alias("valid"))


_DIGITS = "SELECT {key} AS key, lpad(CAST(CAST({key} AS HUGEINT) * {factor} % {mod} AS VARCHAR), {size}, '0') AS digits FROM {table}"


def _digits_sql(key: str, size: int, factor: int, table: str) -> str:
    return _DIGITS.format(key=key, size=size, factor=factor, mod=10**size, table=table)


def _at(i: int) -> str:
    return f"CAST(substr(digits, {i}, 1) AS INT)"


_CHECKS = {
    "check_national_ids": f"""SELECT key, digits || '-' || substr('{checks.ID_LETTERS}', CAST((key + key % 2) % 23 + 1 AS INT), 1) AS value, key % 2 = 0 AS valid
FROM ({_digits_sql("c_custkey", 8, 1, "customer")})""",
    "check_social_security": f"""SELECT key, digits, (CASE WHEN s < 10000000 THEN p * 10000000 + s ELSE CAST(CAST(p AS VARCHAR) || CAST(s AS VARCHAR) AS BIGINT) END) % 97 = c AS valid
FROM (SELECT key, digits, CAST(substr(digits, 1, 2) AS BIGINT) AS p, CAST(substr(digits, 3, 8) AS BIGINT) AS s, CAST(substr(digits, 11, 2) AS BIGINT) AS c
  FROM ({_digits_sql("c_custkey", 12, 7919 * 1009 * 97, "customer")}))""",
    "check_nhs_numbers": f"""SELECT key, digits, w <> 10 AND (CASE WHEN w = 11 THEN 0 ELSE w END) = last AS valid FROM (
  SELECT key, digits, 11 - ({" + ".join(f"{_at(i)} * {11 - i}" for i in range(1, 10))}) % 11 AS w, {_at(10)} AS last FROM ({_digits_sql("o_orderkey", 10, 104729, "orders")}))""",
    "check_tax_numbers": f"""SELECT key, digits, a NOT IN (0, 666) AND a < 900 AND g <> 0 AND s <> 0 AS ssn,
  a >= 900 AND (g BETWEEN 50 AND 65 OR g BETWEEN 70 AND 88 OR g BETWEEN 90 AND 92 OR g BETWEEN 94 AND 99) AS itin
FROM (SELECT key, digits, CAST(substr(digits, 1, 3) AS INT) AS a, CAST(substr(digits, 4, 2) AS INT) AS g, CAST(substr(digits, 6, 4) AS INT) AS s
  FROM ({_digits_sql("o_orderkey", 9, 7368787, "orders")}))""",
    "check_cards": f"""SELECT key, digits, ({" + ".join(_at(i) if i % 2 == 0 else f"(2 * {_at(i)} - CASE WHEN {_at(i)} > 4 THEN 9 ELSE 0 END)" for i in range(1, 17))}) % 10 = 0 AS valid
FROM ({_digits_sql("p_partkey", 16, 1299709 * 15485863, "part")})""",
    "check_ibans": f"""SELECT key, 'ES' || lpad(CAST((98 - CAST((digits || '142800')::HUGEINT % 97 AS INT) + key % 2) % 100 AS VARCHAR), 2, '0') || '00' || digits AS value, key % 2 = 0 AS valid
FROM ({_digits_sql("c_custkey", 18, 104729 * 7919, "customer")})""",
}


def shift_order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates, day first, ISO and in English words, moved by 30 to 180 days by order key."""
    o = _table(spark, sf_dir, "orders").withColumn("d", (F.col("o_orderkey") % 151 + 30).cast("int"))
    shown = {"es": ("dd/MM/yyyy", "es"), "iso": ("yyyy-MM-dd", "en"), "en": ("MMMM d, yyyy", "en")}
    return o.select("o_orderkey", *[shift_date(F.date_format("o_orderdate", f), F.col("d"), F.lit(k)).alias(n) for n, (f, k) in shown.items()])


_SHIFT = """SELECT o_orderkey, strftime(m, '%d/%m/%Y') AS es, strftime(m, '%Y-%m-%d') AS iso, strftime(m, '%B %-d, %Y') AS en
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 151 + 30 AS INT) AS m FROM orders)"""


def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes, doubled, as ages in years and in months."""
    p = _table(spark, sf_dir, "part").withColumn("n", (F.col("p_size") * 2).cast("string"))
    es, en = F.lit("es"), F.lit("en")
    return p.select("p_partkey", age_band(F.concat("n", F.lit(" años de edad")), es).alias("es"), age_band(F.concat("n", F.lit(" years old")), en).alias("en"), age_band(F.concat("n", F.lit(" months old")), en).alias("months"))


_BANDS = """SELECT p_partkey,
  CASE WHEN n >= 85 THEN '85 o más años de edad' ELSE (n // 5 * 5) || '-' || (n // 5 * 5 + 4) || ' años de edad' END AS es,
  CASE WHEN n >= 85 THEN '85 or older' ELSE (n // 5 * 5) || '-' || (n // 5 * 5 + 4) || ' years' END AS en,
  CASE WHEN n >= 100 THEN NULL WHEN n < 12 THEN 'under 1 year' ELSE (n // 12 // 5 * 5) || '-' || (n // 12 // 5 * 5 + 4) || ' years' END AS months
FROM (SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS n FROM part)"""


def word_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as word boxes of a page, three to a line; each order's span from its key: one rectangle a line."""
    w = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") - 1) * 10).alias("start"), ((F.col("l_linenumber") - 1) * 10 + 9).alias("end"),
        F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("line"), F.col("l_linenumber").cast("double").alias("x0"), F.col("l_quantity").alias("y0"),
        (F.col("l_linenumber") + 1).cast("double").alias("x1"), (F.col("l_quantity") + 1).alias("y1"),
    )
    s = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("span_id"), (F.col("o_orderkey") % 30).cast("int").alias("start"), (F.col("o_orderkey") % 30 + 25).cast("int").alias("end"))
    return geometry.span_rectangles(s, w, ["doc_id"])


_RECTANGLES = """SELECT o_orderkey AS doc_id, 1 AS span_id, CAST((l_linenumber - 1) // 3 AS INT) AS line, min(CAST(l_linenumber AS DOUBLE)) AS x0, min(l_quantity) AS y0,
  max(CAST(l_linenumber + 1 AS DOUBLE)) AS x1, max(l_quantity + 1) AS y1
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE (l_linenumber - 1) * 10 < o_orderkey % 30 + 25 AND (l_linenumber - 1) * 10 + 9 > o_orderkey % 30 GROUP BY 1, 2, 3"""


def cell_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells of a sheet for each order: values get their column's first value or their left neighbour."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cells = _table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("sheet"), "row", F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("l_returnflag").alias("value")), F.struct(F.lit(2).alias("col"), F.col("l_linestatus").alias("value")), F.struct(F.lit(4).alias("col"), F.col("l_suppkey").cast("string").alias("value")))).alias("c")
    )
    cells = cells.select("sheet", "row", "c.*", (F.col("c.col") == 2).alias("is_formula"))
    return search.with_cell_context(cells, ["sheet"]).select("sheet", "row", "col", "text", "value_start", "value_end")


_CELLS = """WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS r FROM lineitem),
c AS (SELECT l_orderkey AS sheet, r AS row, 1 AS col, l_returnflag AS value FROM i
  UNION ALL SELECT l_orderkey, r, 2, l_linestatus FROM i UNION ALL SELECT l_orderkey, r, 4, CAST(l_suppkey AS VARCHAR) FROM i),
x AS (SELECT *, CASE WHEN row > 1 AND col <> 2 THEN max(CASE WHEN row = 1 THEN value END) OVER (PARTITION BY sheet, col) END AS head,
  CASE WHEN col = 2 THEN max(CASE WHEN col = 1 THEN value END) OVER (PARTITION BY sheet, row) END AS near FROM c),
y AS (SELECT *, coalesce(head, near) AS label FROM x)
SELECT sheet, row, col, CASE WHEN label IS NULL OR label = value THEN value ELSE label || ': ' || value END AS text,
  CAST(CASE WHEN label IS NULL OR label = value THEN 0 ELSE length(label) + 2 END AS INT) AS value_start,
  CAST(CASE WHEN label IS NULL OR label = value THEN length(value) ELSE length(label) + 2 + length(value) END AS INT) AS value_end FROM y"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        detect_documents, detect_conversations, detect_emails, detect_cards, doc_language, language_counts, redact_documents, redact_emails,
        audit_by_category, term_search, check_national_ids, check_social_security, check_nhs_numbers, check_tax_numbers, check_cards, check_ibans,
        shift_order_dates, age_bands, word_rectangles, cell_contexts,
    )
} | sample_queries.QUERIES

ORACLE_SQL: dict[str, str] = {
    "detect_emails": _COUNTED.format(_EMAILS),
    "detect_cards": _COUNTED.format(_CARDS),
    "doc_language": f"SELECT doc_id, language FROM ({_LANGUAGE})",
    "language_counts": f"SELECT lang, language, count(*) AS n FROM ({_LANGUAGE}) GROUP BY lang, language",
    "redact_emails": _REDACTED,
    "audit_by_category": _AUDIT,
    "term_search": _TERMS,
    "shift_order_dates": _SHIFT,
    "age_bands": _BANDS,
    "word_rectangles": _RECTANGLES,
    "cell_contexts": _CELLS,
    **_CHECKS,
    **sample_queries.ORACLE_SQL,
}
