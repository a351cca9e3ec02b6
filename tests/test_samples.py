"""Registered queries over small tables with keys that larger tables have."""

from pyspark.sql import functions as F

from velar.functions import spans
from velar.plans import queries, recognizers, sample_queries, samples


def test_keys_of_any_size_as_card_numbers(spark, tmp_path):
    keys = [0, 1, 458_245, 1_200_000, 10**12, 2**63 - 1]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.key: r for r in queries.check_cards(spark, str(tmp_path)).collect()}

    def luhn(digits):
        return sum(int(d) if i % 2 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(digits)) % 10 == 0

    for k in keys:
        digits = f"{k * 1299709 * 15485863 % 10**16:016}"
        assert (got[k].digits, got[k].valid) == (digits, luhn(digits))


def test_words_of_a_turn_are_no_context_of_the_sentence_behind_it(spark, tmp_path):
    turns = [(9, 15, "the thtish."), (509, 7, "theed, thtishtion"), (2691, 0, "asci. Ómentell en que."), (2691, 1, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.key: (r.block, r.detector, r.score) for r in sample_queries.detect_turns(spark, str(tmp_path)).collect()}
    assert got[509007] == (15, "health_card", 90) and got[2691000] == (4, "phone", 45)  # with "tis" and "tel" in the words before: 100 and 80
    assert sorted(got) == [9015, 509007, 2691000, 2691001]


def test_texts_of_a_small_file_are_work_for_all_cores(spark, tmp_path):
    spark.range(40).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = sample_queries.find_english(spark, str(tmp_path))
    sizes = found.rdd.glom().map(len).collect()
    assert sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) > 900


def test_spans_with_digits_at_both_ends_keep_their_edges(spark):
    words, signs = ["nº", "de", "calle"], recognizers.EDGE_SIGNS
    texts = ["12", "1.2", "(12", "12)", "a1 b 2c", "de 12", "12 de", "12 calle", "calle 1", "1 de 2", "12 ", " 12", "12\u2003de", "x2\u20281", "nº", "1º", "nº1", "-1-", "A1 º2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lit(0).alias("a"), F.length("t").alias("b"))
    by = lambda w: spans.without_edges(F.col("t"), F.col("a"), F.col("b"), w, signs)
    rows = df.select("t", by(words).alias("fast"), by([*words, "77"]).alias("slow")).collect()  # a word with digits: each is looked at
    assert [(r.t, tuple(r.fast)) for r in rows] == [(r.t, tuple(r.slow)) for r in rows]
    assert {r.t: tuple(r.fast) for r in rows}["de 12"] == (3, 5)


def test_least_digits_of_a_match_let_all_samples_pass():
    import re

    lists = {"es": recognizers.SPANISH, "en": recognizers.ENGLISH}
    known = {k: {(r.name, r.category): r.least for r in v} for k, v in lists.items()}
    assert set(recognizers.LEAST_DIGITS) <= {*known["es"], *known["en"]}
    shapes = [("es", "national_id", "12345678Z"), ("es", "foreigner_id", "X1234567L"), ("es", "plate", "1234BCD"), ("es", "old_plate", "M-1234-A"), ("es", "date", "1/1/20"), ("es", "iso_date", "2024-01-01"), ("es", "card", "4000 1234 5678 9"),
              ("es", "iban_digits", "NO93 8601 1117 947"), ("es", "iban_digits", "ES00 1234 1234"), ("es", "social_security", "28 1234567 12"), ("es", "phone", "612345678"), ("es", "company_id", "A1234567J"), ("en", "nhs", "123 456 7890"), ("en", "itin", "912-70-1234"),
              ("en", "us_phone", "(212) 555-0147"), ("en", "uk_phone", "020 7946 000"), ("en", "us_zip", "12345-1234"), ("en", "ssn", "123 12 1234")]
    for language, name, value in shapes:
        r = next(r for r in lists[language] if r.name == name)
        body = re.sub(r"\\p\{L\}\\p\{N\}_", r"\\w", r.pattern)
        assert re.search("(?i)" + body, value) and len(re.sub(r"\D", "", value)) >= r.least, name


def test_detections_that_are_read_twice_are_made_once(spark, tmp_path):
    spark.range(3).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    email = recognizers.SPANISH[0].regex()
    for query in (sample_queries.evaluate_reports, sample_queries.redact_approved):
        made = query(spark, str(tmp_path))
        assert email not in made._jdf.queryExecution().optimizedPlan().toString(), query  # written before, by the query
        assert made.count() in (16, 3 * len(samples.SPANISH))
