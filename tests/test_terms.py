import random
import re

from pyspark.sql import functions as F

from velar.operators import detect, search, terms


def brute(text, term, whole=False):
    out, free = [], 0
    for m in range(len(text) - len(term) + 1):
        if terms.folded(text[m : m + len(term)]) == terms.folded(term):
            a, b = m, m + len(term)
            if whole and (a and re.match(r"\w", text[a - 1]) or b < len(text) and re.match(r"\w", text[b])):
                continue
            if a >= free:
                out.append((term, a, b))
                free = b
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, ""]) if i % 17 == 0 else "".join(rng.choices("aAbBñÑ é_İß1", k=rng.randint(0, 60)))) for i in range(n)]


def test_places_against_brute_force_in_one_block_and_many(spark):
    rng, rows = random.Random(2), corpus(60, 1)
    words = sorted({"".join(rng.choices("abñé1 ", k=rng.randint(1, 4))).strip() for _ in range(60)} - {""})
    table = spark.createDataFrame([(f" {w} ",) for w in words] + [(None,), ("  ",), (words[0],)], "term string")
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for whole in (False, True):
        want = sorted((i, *p) for i, t in rows for w in words for p in brute(t or "", w, whole))
        for size in (1 << 20, 40):
            assert sorted(tuple(r) for r in terms.hits(docs, table, ["doc_id"], whole=whole, block_bytes=size).collect()) == want
    assert sorted(tuple(r) for r in search.term_hits(docs, words[:3], ["doc_id"]).collect()) == sorted((i, *p) for i, t in rows for w in words[:3] for p in brute(t or "", w))


def test_empty_tables_and_plan_size(spark):
    docs = spark.createDataFrame(corpus(9, 3), "doc_id int, text string")
    none = spark.createDataFrame([], "term string")
    assert terms.hits(docs, none, ["doc_id"]).count() == 0 and terms.hits(docs.limit(0), ["a"], ["doc_id"]).count() == 0
    many = spark.range(100_000).select(F.concat(F.lit("t"), "id").alias("term"))
    few = spark.range(3).select(F.concat(F.lit("t"), "id").alias("term"))
    sizes = [len(terms.hits(docs, t, ["doc_id"])._jdf.queryExecution().executedPlan().toString()) for t in (few, many)]
    assert abs(sizes[0] - sizes[1]) < 100
    big = spark.createDataFrame([(1, "x T7 t99999 t100000 tt5")], "doc_id int, text string")
    assert {r.term for r in terms.hits(big, many, ["doc_id"], whole=True).collect()} == {"t7", "t99999"}


def test_terms_of_their_own_documents(spark):
    docs = spark.createDataFrame([(1, 0, "Ana and Bob"), (1, 1, "bob"), (2, 0, "Bob and ana"), (3, 0, None)], "doc int, block int, text string")
    own = spark.createDataFrame([(1, "ana"), (1, "ana"), (2, " Bob"), (3, "x"), (None, "and")], "doc int, term string")
    assert sorted(tuple(r) for r in terms.own_hits(docs, own, "doc", ["doc", "block"]).collect()) == [(1, 0, "ana", 0, 3), (2, 0, "Bob", 0, 3)]


def test_detection_with_tables_is_that_with_lists(spark):
    rng = random.Random(5)
    own, allow = ["saw the", "Colegiado", "example", "b.org"], ["A@b.org ", "example", "612 345 678"]
    parts = ["mail a@b.org", "x@y.example now", "Tel. 612 345 678", "colegiado", "saw the", "EXAMPLE", "c@b.org", "ok"]
    rows = [(i, " ".join(rng.choices(parts, k=6))) for i in range(40)] + [(98, None), (99, " ")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    table = lambda x: spark.createDataFrame([(t,) for t in x], "term string")
    for chosen in (None, ["email", "custom_term"], ["email"]):
        lists = detect.with_spans(docs, chosen, custom=own, allow=allow)
        tables = detect.with_spans(docs, chosen, own_terms=table(own), allow_terms=table(allow))
        assert lists.columns == tables.columns
        assert sorted(map(str, lists.collect())) == sorted(map(str, tables.collect()))
