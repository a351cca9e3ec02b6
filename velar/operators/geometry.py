"""Pages as tables of words and images with boxes: texts, coverage, which pages need OCR, letterheads, rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shortest text layers, shares of a page, OCR confidence and resolution, points of an inch.
LEAST_TEXT, LEAST_PAGE, IMAGE_SHARE, LEAST_WITH_IMAGE = 20, 15, 0.55, 600
LETTERHEAD_TOP, LETTERHEAD_BOTTOM, LOGO_SCORE = 0.20, 0.88, 0.6
LEAST_CONFIDENCE, DPI, POINTS = 40, 220, 72


BIN = 256  # characters of a page's text that words and spans are dealt by


def reading_order(words: DataFrame, page: list[str], gutter: float | None = None) -> DataFrame:
    """words (word, x0, y0, x1, y1) with `column`, `line` and `word_no`, all from 0 on each page: the order of reading.

    Words from the top: a word whose middle lies below all that came before begins a line; a line's words go from left
    to right. With a gutter, words are dealt into columns first: from the left, a word further than that from all that
    came before begins a column, and columns are read one after another. Without one, a page is one column. Equal places
    go by the word. Words that repeat each count; null boxes come first; an empty table gives an empty result.
    """

    def islands(df: DataFrame, by: list[str], first: str, reach: str, begins: Column, out: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.asc_nulls_first(first), reach, "x0", "x1", "word")
        before = F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = df.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNotNull() & begins, 1).otherwise(0))
        return new.withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_before", "_new")

    dealt = words.withColumn("column", F.lit(0)) if gutter is None else islands(words, page, "x0", "x1", F.col("x0") > F.col("_before") + gutter, "column")
    lined = islands(dealt, [*page, "column"], "y0", "y1", (F.col("y0") + F.col("y1")) / 2 >= F.col("_before"), "line")
    order = Window.partitionBy(*page).orderBy("column", "line", "x0", "x1", "y0", "y1", "word")
    return lined.withColumn("word_no", F.row_number().over(order) - 1)


def derotated(words: DataFrame, width: str = "width", height: str = "height", rotation: str = "rotation") -> DataFrame:
    """words with boxes of the page as it is shown, turned clockwise by `rotation`, moved to the page as it is stored.

    width and height are the stored page's. Rotations count modulo 360; others than quarter turns leave boxes alone.
    """
    turn, w, h = F.pmod(F.col(rotation), F.lit(360)), F.col(width), F.col(height)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    to = {90: (y0, h - x1, y1, h - x0), 180: (w - x1, h - y1, w - x0, h - y0), 270: (w - y1, x0, w - y0, x1)}
    boxes = {}
    for i, c in enumerate(("x0", "y0", "x1", "y1")):
        out = F.col(c)
        for k, box in to.items():
            out = F.when(turn == k, box[i]).otherwise(out)
        boxes[c] = out
    return words.withColumns(boxes)


def with_recognised(words: DataFrame, pages: DataFrame, read: DataFrame, page: list[str], dpi: int = DPI) -> DataFrame:
    """(page keys, word, x0, y0, x1, y1, column, line, word_no, by_ocr): the words of all pages, read by OCR where that was asked.

    pages (width, height, rotation, needs_ocr) says which pages' words give way to those of `read` (word, conf and a box
    in pixels of the page as shown): sure ones, in points, turned back. Such a page without any has no words.
    """
    wanted = pages.where("needs_ocr").select(*page, "width", "height", "rotation")
    box = ["word", "x0", "y0", "x1", "y1"]
    own = words.join(wanted.select(*page), page, "left_anti").select(*page, *box, F.lit(False).alias("by_ocr"))
    seen = recognised_words(read, dpi).join(wanted, page)
    turned = derotated(seen).select(*page, *box, F.lit(True).alias("by_ocr"))
    return reading_order(own.unionByName(turned), page)


def page_words(words: DataFrame, page: list[str], order: str = "word_no") -> DataFrame:
    """words with start and end, the place of each word in its page's text, in which words are joined by one space.

    Words come in the order of the column; null and empty ones are left out.
    """
    some = words.where("word is not null and word != ''")
    before = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("word") + 1).over(before) - 1
    return some.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("word")).cast("int"))


def page_texts(words: DataFrame, page: list[str], order: str = "word_no") -> DataFrame:
    """(page keys, text, n_words): each page's words in order, joined by one space."""
    some = words.where("word is not null and word != ''").groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "word"))).alias("w"))
    return some.select(*page, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.size("w").alias("n_words"))


def recognised_words(words: DataFrame, dpi: int = DPI) -> DataFrame:
    """OCR words (conf, word, x0, y0, x1, y1 in pixels) that are sure enough, with boxes in points."""
    scaled = {c: F.col(c) * F.lit(POINTS / dpi) for c in ("x0", "y0", "x1", "y1")}
    return words.where((F.col("conf") >= LEAST_CONFIDENCE) & (F.trim("word") != "")).withColumns(scaled)


def image_cover(pages: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    """pages (width, height) with `cover`: the largest image's share of the page, 1 at most; 0 without an image."""
    area = images.groupBy(*page).agg(F.max((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("_area"))
    joined = pages.join(area, page, "left")
    share = F.coalesce(F.try_divide("_area", F.col("width") * F.col("height")), F.lit(0.0))
    return joined.withColumn("cover", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("_area")


def needs_ocr(text: Column, cover: Column) -> Column:
    """Whether a page has next to no text, or a large image with little text."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return (n < LEAST_PAGE) | ((cover > IMAGE_SHARE) & (n < LEAST_WITH_IMAGE))


def has_text(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, has_text): whether a document's pages have a useful text layer between them."""
    return pages.groupBy(doc).agg((F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))) >= LEAST_TEXT).alias("has_text"))


def letterheads(pages: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    """(page keys, x0, y0, x1, y1, category, score): images whose middle is in a page's head or foot, not the page itself.

    Pages that OCR has read (by_ocr) have none: their image is the page.
    """
    on = images.join(pages.where("not by_ocr").select(*page, "width", "height"), page)
    middle = (F.col("y0") + F.col("y1")) / 2 / F.col("height")
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    some = on.where(((middle <= LETTERHEAD_TOP) | (middle >= LETTERHEAD_BOTTOM)) & (share <= IMAGE_SHARE))
    return some.select(*page, "x0", "y0", "x1", "y1", F.lit("logo").alias("category"), F.lit(LOGO_SCORE).alias("score"))


def span_rectangles(found: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """One rectangle per span and line: the words (start, end, line, x0, y0, x1, y1) that meet (span_id, start, end).

    Words and spans are dealt into bins of BIN characters and joined by page and bin, so that a page with very many of
    both isn't paired out; two that share several bins meet in the first one of these only.
    """
    bins = lambda a, b: F.sequence(F.floor(a / BIN), F.floor(F.greatest(b - 1, a) / BIN))
    s = found.select(*keys, "span_id", F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s <= _e")
    s = s.withColumn("_bin", F.explode(bins(F.col("_s"), F.col("_e")))).withColumn("_from", F.floor(F.col("_s") / BIN))
    w = words.where("start <= end").withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
    once = F.col("_bin") == F.greatest("_from", F.floor(F.col("start") / BIN))
    met = w.join(s, [*keys, "_bin"]).where(once & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
    return met.groupBy(*keys, "span_id", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def page_edits(spans: DataFrame, rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """rectangles with `replacement`: that of the span if it has one rectangle, else null, which is a black box."""
    one = Window.partitionBy(*keys, "span_id")
    counted = rectangles.withColumn("_n", F.count(F.lit(1)).over(one))
    joined = counted.join(spans.select(*keys, "span_id", "replacement"), [*keys, "span_id"])
    return joined.withColumn("replacement", F.when(F.col("_n") == 1, F.col("replacement"))).drop("_n")
