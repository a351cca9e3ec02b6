import pytest
from pyspark.sql import functions as F

from velar.operators import geometry, layers, search


@pytest.mark.parametrize("reply,want", [
    ('{"entidades": [{"texto": " Ana ", "tipo": "Persona"}]}', [("Ana", "persona")]),
    ('<think>{"entidades": [{"texto": "no", "tipo": "x"}]}</think>\n```json\n{"entidades": [{"texto": "A{b}\\"", "tipo": "LUGAR"}]}\n```', [('A{b}"', "lugar")]),
    ('so {not json} then {"entidades": [{"texto": "B", "tipo": "email"}, 3, {"tipo": "fecha"}]} and {"entidades": []}', [("B", "email"), ("", "fecha")]),
    ('{"entidades": {"texto": "x"}}', []), ('{"other": 1}', []), ("[1, 2]", []), ("no braces", []), ('{"entidades": [', []), ("", []), (None, []),
])
def test_fragments_of_replies(reply, want):
    assert [(f["fragment"], f["kind"]) for f in layers.fragments_of(reply)] == want


def test_proposals_stand_in_the_text_as_whole_words(spark):
    blocks = spark.createDataFrame([(1, 0, "Ana\tvio a anamnesis, ANA y $5.\nÑu"), (1, 1, None), (2, 0, "Ana")], "doc long, block int, text string")
    replies = spark.createDataFrame([(1, 0, '{"entidades": [{"texto": "ana", "tipo": "paciente"}, {"texto": "$5.", "tipo": "lugar"}, {"texto": "ñu", "tipo": "lugar"}]}'), (1, 0, "junk"), (1, 1, '{"entidades": [{"texto": "ana", "tipo": "paciente"}]}'), (9, 0, "{}")], "doc long, block int, reply string")
    rows = {(r.doc, r.block): sorted((s.start, s.end, s.category) for s in r.proposed) for r in layers.proposed(blocks, replies, ["doc", "block"]).collect()}
    assert rows == {(1, 0): [(0, 3, "person"), (21, 24, "person"), (27, 30, "place_or_postcode")], (1, 1): [], (2, 0): []}
    only = layers.proposed(blocks, replies, ["doc", "block"], categories=["localidad"]).where("size(proposed) > 0").collect()
    assert [len(r.proposed) for r in only] == [1]


def test_pages(spark):
    pages = spark.createDataFrame([(1, 100.0, 200.0, "x" * 14, False), (2, 100.0, 200.0, "x" * 599, False), (3, 100.0, 200.0, "x" * 600, False), (4, 0.0, 0.0, None, True)], "page int, width double, height double, text string, by_ocr boolean")
    images = spark.createDataFrame([(2, 0.0, 0.0, 100.0, 111.0), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 900.0, 900.0), (4, 0.0, 0.0, 5.0, 5.0), (2, 0.0, 170.0, 20.0, 190.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    covered = geometry.image_cover(pages, images, ["page"])
    rows = {r.page: (round(r.cover, 3), r.need) for r in covered.withColumn("need", geometry.needs_ocr(F.col("text"), F.col("cover"))).collect()}
    assert rows == {1: (0.0, True), 2: (0.555, True), 3: (1.0, False), 4: (0.0, True)}
    assert sorted((r.page, r.y0) for r in geometry.letterheads(pages, images, ["page"]).collect()) == [(2, 0.0), (2, 170.0)]
    words = spark.createDataFrame([(1, 2, "b"), (1, 1, "aé"), (1, 3, ""), (1, 4, None), (2, 1, "c")], "page int, word_no int, word string")
    assert sorted((r.page, r.start, r.end) for r in geometry.page_words(words, ["page"]).collect()) == [(1, 0, 2), (1, 3, 4), (2, 0, 1)]
    assert {r.page: r.text for r in geometry.page_texts(words, ["page"]).collect()} == {1: "aé b", 2: "c"}


def test_visible_values_and_clipping(spark):
    cases = [
        ("date", "2024-03-05 00:00:00", "m/d/yy", "05/03/2024"), ("date", "2024-03-05 07:08:09", None, "05/03/2024 07:08:09"), ("time", "1899-12-30 07:08:09", "h:mm", "07:08:09"), ("number", "42.0", "0000", "0042"),
        ("number", "42", "0.00", "42"), ("number", "4.5", "0000", "4.5"), ("number", "-3.0", None, "-3"), ("number", "123456", "0000", "123456"), ("text", "007", "0000", "007"), ("date", "odd", None, "odd"), ("text", None, None, None),
    ]
    df = spark.createDataFrame(cases, "kind string, value string, format string, want string")
    got = df.withColumn("got", search.visible_value(F.col("kind"), F.col("value"), F.col("format")))
    assert got.where("not (got <=> want)").collect() == []
