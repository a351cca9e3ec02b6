import random

from velar.llm import language


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(0)
    alphabets = {"xx": "abcdeé", "yy": "defghß", "zz": "aehijkñ"}
    word = lambda a: "".join(rng.choices(a, k=rng.randint(2, 7)))
    rows = [(i, " ".join(word(a) for _ in range(20)), lang) for i in range(240) for lang, a in [rng.choice(sorted(alphabets.items()))]]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 %% \n", "zz"), (1003, "abc", None), (None, "abé abé", "xx"), (0, "again", "xx"), (1004, "𐐷𐐷 𐐷", "zz"), (1005, "É" * 1200000, "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "lang as lang_pred", "1 as score")
    model = language.train(docs.where("doc_id < 160"))
    got = language.predicted(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == len(rows) + len(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert sum(by[i].lang_pred == lang for i, _, lang in rows if i >= 160) >= 78
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1005)] == ["und", "und", "und", "xx"]
    assert by[1004].lang_pred != "und" and got.where("score is null or score not between 0 and 1").count() == 0
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predicted(docs, nothing).collect()} == {"und"}
    assert language.predicted(docs.limit(0), model).count() == 0


def test_any_number_of_languages_by_blocks(spark, monkeypatch):
    """Blocks of two languages give what one block of all gives; tasks that hand their sums on early lose nothing."""
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh"[k % 5 : k % 5 + 4], k=4)) for _ in range(9)), f"l{k}") for i in range(150) for k in [rng.randrange(7)]]
    docs = spark.createDataFrame(rows + [(900, None, "l1"), (901, "12", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.docs) == 7 and [b.names for b in model.blocks(3)] == [("l0", "l1", "l2"), ("l3", "l4", "l5"), ("l6",)]
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predicted(docs, model, block=n).collect()} for n in (500, 2))
    assert one == many and one[900] == one[901] == ("und", 0.0)
    lots = spark.createDataFrame([(i, "abc " * 3, f"x{i:04}") for i in range(1203)], "doc_id long, text string, lang string").coalesce(1)
    big = language.train(lots)
    assert len(big.docs) == 1203 and big.rows.where(f"bucket = {language.DIM}").agg({"n": "sum"}).first()[0] == 1203
    assert {r.lang_pred for r in language.predicted(lots.limit(3), big).collect()} == {"x0000"}


def test_long_words_are_not_cut():
    word = "é" * (language.BLOCK + 5)
    at, n = language.buckets(f"ab {word} .. cd".encode())
    assert n.sum() == (4 + len(word)) + (7 + len(word)) + (6 + len(word))  # letters, pairs, triples of " ab word cd "


def test_buckets_count_each_gram_once_per_place():
    at, n = language.buckets(b"ab, ab")
    # letters a, b twice; borders and pairs " a" "ab" "b " twice; triples " ab" "ab " twice and "b a" once
    assert n.sum() == 4 + 6 + 5
    assert [len(x) for x in language.buckets(b"12 .")] == [0, 0]
