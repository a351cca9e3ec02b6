import random

from pyspark.sql import functions as F

from velar.operators import geometry

BOX = "page int, word string, x0 double, y0 double, x1 double, y1 double"


def sweep(words, gutter):
    """Order of reading step by step: columns by what lies to the left, lines by what lies above."""

    def islands(rows, first, reach, begins):
        out, reached, n = {}, None, 0
        for r in sorted(rows, key=lambda r: (r[first], r[reach], r[2], r[4], r[1])):
            if reached is not None and begins(r, reached):
                n += 1
            reached = r[reach] if reached is None else max(reached, r[reach])
            out[r] = n
        return out

    got = {}
    for page in {w[0] for w in words}:
        own = [w for w in words if w[0] == page]
        column = islands(own, 2, 4, lambda r, x: x + gutter < r[2]) if gutter is not None else dict.fromkeys(own, 0)
        line = {}
        for c in set(column.values()):
            line |= islands([w for w in own if column[w] == c], 3, 5, lambda r, y: (r[3] + r[5]) / 2 >= y)
        ordered = sorted(own, key=lambda w: (column[w], line[w], w[2], w[4], w[3], w[5], w[1]))
        got |= {w: (column[w], line[w], k) for k, w in enumerate(ordered)}
    return got


def test_reading_order_is_the_sweep(spark):
    rng = random.Random(4)
    words = []
    for k in range(400):
        x, y = rng.randint(0, 80), rng.randint(0, 60)
        words.append((k % 7, f"w{k}", float(x), float(y), float(x + rng.randint(1, 9)), float(y + rng.randint(1, 6))))
    df = spark.createDataFrame(words, BOX)
    for gutter in (None, 0.0, 3.0):
        want = sweep(words, gutter)
        for r in geometry.reading_order(df, ["page"], gutter).collect():
            assert (r.column, r.line, r.word_no) == want[r.page, r.word, r.x0, r.y0, r.x1, r.y1]
    assert geometry.reading_order(df.limit(0), ["page"]).count() == 0


def test_lines_and_columns_by_eye(spark):
    page = [(1, "b", 10, 0, 15, 10), (1, "a", 0, 2, 5, 9), (1, "c", 0, 11, 5, 20), (1, "z", 60, 1, 70, 9), (1, "y", 60, 12, 70, 19)]
    df = spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in page], BOX)
    order = lambda g: [r.word for r in geometry.reading_order(df, ["page"], g).orderBy("word_no").collect()]
    assert order(None) == list("abzcy") and order(20.0) == list("abczy")


def test_boxes_turn_back(spark):
    rows = [(k, 1.0, 2.0, 4.0, 8.0, 100.0, 200.0, k * 90) for k in range(-1, 6)] + [(9, 1.0, 2.0, 4.0, 8.0, 100.0, 200.0, 45)]
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double, width double, height double, rotation int")
    got = {r.k: (r.x0, r.y0, r.x1, r.y1) for r in geometry.derotated(df).collect()}

    def shown(x, y, turns):  # a stored point as the page shows it
        w, h = 100.0, 200.0
        for _ in range(turns % 4):
            x, y, w, h = h - y, x, h, w
        return x, y

    for k in range(-1, 6):
        x0, y0, x1, y1 = got[k]
        corners = [shown(x, y, k) for x in (x0, x1) for y in (y0, y1)]
        assert (min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)) == (1.0, 2.0, 4.0, 8.0)
    assert got[9] == (1.0, 2.0, 4.0, 8.0)


def test_words_of_read_pages_give_way(spark):
    words = spark.createDataFrame([(1, "own", 0.0, 0.0, 1.0, 1.0), (2, "gone", 0.0, 0.0, 1.0, 1.0), (3, "gone", 0.0, 0.0, 1.0, 1.0)], BOX)
    pages = spark.createDataFrame([(1, 10.0, 20.0, 0, False), (2, 10.0, 20.0, 180, True), (3, 10.0, 20.0, 0, True)], "page int, width double, height double, rotation int, needs_ocr boolean")
    read = spark.createDataFrame([(1, "no", 99.0, 0.0, 0.0, 9.0, 9.0), (2, "yes", 40.0, 2.0, 2.0, 4.0, 4.0), (2, "unsure", 39.0, 2.0, 2.0, 4.0, 4.0), (2, " ", 99.0, 0.0, 0.0, 1.0, 1.0)], "page int, word string, conf double, x0 double, y0 double, x1 double, y1 double")
    got = geometry.with_recognised(words, pages, read, ["page"], dpi=72).collect()
    assert sorted((r.page, r.word, r.by_ocr, r.x0, r.y0, r.x1, r.y1) for r in got) == [(1, "own", False, 0.0, 0.0, 1.0, 1.0), (2, "yes", True, 6.0, 16.0, 8.0, 18.0)]


def test_rectangles_against_all_pairs(spark):
    rng = random.Random(8)
    words, spans = [], []
    for page in (1, 2):
        at = 0
        for k in range(300):
            n = rng.choice([1, 4, 9, 700]) if k % 50 == 0 else rng.randint(1, 9)
            words.append((page, at, at + n, k // 10, float(k), float(k // 10), float(k + 1), float(k // 10 + 1)))
            at += n + 1
        for s in range(60):
            a = rng.randint(0, at)
            spans.append((page, s, a, a + rng.choice([0, 1, 5, 300, 2000])))
    got = geometry.span_rectangles(spark.createDataFrame(spans, "page int, span_id int, start int, end int"), spark.createDataFrame(words, "page int, start int, end int, line int, x0 double, y0 double, x1 double, y1 double"), ["page"])
    want = {}
    for page, s, a, b in spans:
        for p, c, d, line, *box in words:
            if p == page and c < b and d > a:
                o = want.get((page, s, line), box)
                want[page, s, line] = [min(o[0], box[0]), min(o[1], box[1]), max(o[2], box[2]), max(o[3], box[3])]
    assert {(r.page, r.span_id, r.line): [r.x0, r.y0, r.x1, r.y1] for r in got.collect()} == want


def test_a_crowded_page_is_not_paired_out(spark):
    """A page of 60,000 words and 6,000 spans: rows of the join grow with what meets, not with the product."""
    words = spark.range(60_000).select(F.lit(1).alias("page"), (F.col("id") * 6).cast("int").alias("start"), (F.col("id") * 6 + 5).cast("int").alias("end"), (F.col("id") / 10).cast("int").alias("line"), *[F.col("id").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    spans = spark.range(6_000).select(F.lit(1).alias("page"), F.col("id").alias("span_id"), (F.col("id") * 60).cast("int").alias("start"), (F.col("id") * 60 + 11).cast("int").alias("end"))
    assert geometry.span_rectangles(spans, words, ["page"]).count() == 6_000
