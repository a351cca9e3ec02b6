"""Approved detections taken out of texts: blocked, shifted or banded; then checked and counted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velar.functions import spans
from velar.functions.dates import age_band, is_age, shift_date
from velar.plans import recognizers as R
from velar.sources.tables import written

BLOCK, SHORTEST_BLOCK = "█", 4
MOST_RESIDUALS, SHORTEST_RESIDUAL, EXAMPLES = 30, 4, 3
EDIT = "struct<start:int,end:int,replacement:string>"


def substituted(text: Column, edits: Column) -> Column:
    """The text with each edit (start, end, replacement) made; a null replacement blocks its span out.

    Edits go in order of place; of overlapping ones the later begins where the earlier ended; empty ones do nothing.
    """
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))))

    def step(acc: Column, e: Column) -> Column:
        start = F.least(F.greatest(e["start"], acc["at"]), F.length(text))
        end = F.least(e["end"], F.length(text))
        block = F.repeat(F.lit(BLOCK), F.greatest(F.lit(SHORTEST_BLOCK), end - start))
        new = F.concat(acc["out"], spans.piece(text, acc["at"], start), F.coalesce(e["replacement"], block))
        return F.when(end > start, F.struct(end.alias("at"), new.alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], spans.piece(text, acc["at"], F.length(text))))


def replacement(category: Column, text: Column, language: Column, days: Column, dates: str, ages: str) -> Column:
    """What stands for a detection: a shifted date, an age band, or null for a block. Birth dates are always blocked."""
    shifted = F.when(category == "date", shift_date(text, days, language)) if dates == "shift" else F.lit(None).cast("string")
    banded = F.when((category == "birth_or_age") & is_age(text, language), age_band(text, language)) if ages == "band" else F.lit(None).cast("string")
    return F.coalesce(shifted, banded)


def edits_of(found: Column, text: Column, language: Column, days: Column, dates: str = "block", ages: str = "block", terms: Iterable[str] = ()) -> Column:
    """array<EDIT>: one edit for each span, and one for every place of the literal terms."""
    value = lambda s: spans.piece(text, s["start"], s["end"])
    plain = dates != "shift" and ages != "band"
    new = lambda s: F.lit(None).cast("string") if plain else spans.let(value(s), lambda v: replacement(s["category"], v, language, days, dates, ages))
    edits = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("replacement")))
    for term in sorted({t.strip() for t in terms if t and t.strip()}):
        places = spans.find_all(text, spans.literal(term))
        edits = F.concat(edits, F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("replacement"))))
    return edits


def redacted(
    found: DataFrame, days: Column | None = None, dates: str = "block", ages: str = "block", terms: Iterable[str] = (), text_col: str = "text"
) -> DataFrame:
    """The rows of with_spans() with `redacted`, in which all spans and every place of the literal terms are taken out,
    and `edits`, how many places that were. Where edits is 0 nothing was asked for.
    """
    text, days = F.col(text_col), F.lit(0) if days is None else days
    made = found.withColumn("_edits", edits_of(F.col("spans"), text, F.col("language"), days, dates, ages, terms))
    done = made.withColumn("redacted", F.when(text.isNotNull(), substituted(text, F.col("_edits"))))
    return done.withColumn("edits", F.coalesce(F.size("_edits"), F.lit(0))).drop("_edits")


def with_ids(found: DataFrame, doc: str, block: str) -> DataFrame:
    """first_id: the number of a document's detections in its earlier blocks. Detection i of a block is d<first_id + i>."""
    before = Window.partitionBy(doc).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("first_id", (F.sum(F.size("spans")).over(before) - F.size("spans")).cast("int"))


def numbered(found: DataFrame, doc: str, block: str) -> DataFrame:
    """det_id of detections as rows: d0, d1, ... within each document, by block and place."""
    order = Window.partitionBy(doc).orderBy(block, "start", "end")
    return found.withColumn("det_id", F.concat(F.lit("d"), F.row_number().over(order) - 1))


def approved(found: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """Detections as rows that approvals names; approvals of unknown detections are ignored."""
    return found.join(approvals.select(*keys).distinct(), keys, "left_semi")


def with_approved_spans(found: DataFrame, approvals: DataFrame, doc: str, block: str) -> DataFrame:
    """The rows of with_spans() with only those spans that approvals (doc, det_id) names.

    A document's approvals travel as one array, so that the texts are not exploded; unknown ids are ignored.
    """
    ids = approvals.groupBy(F.col(doc).alias("_doc")).agg(F.collect_set("det_id").alias("_ids"))
    numbered_ = with_ids(found, doc, block).join(ids, F.col(doc) == F.col("_doc"), "left").drop("_doc")
    keep = lambda s, i: F.coalesce(F.array_contains("_ids", F.concat(F.lit("d"), (F.col("first_id") + i).cast("string"))), F.lit(False))
    return numbered_.withColumn("spans", F.filter("spans", keep)).drop("_ids", "first_id")


def leftovers(done: DataFrame, texts: DataFrame, doc: str, block: str | None = None, redacted_col: str = "redacted") -> DataFrame:
    """(doc, text): approved texts that a document's redacted blocks, joined by spaces, still hold in any letter case.

    Without block every document is one row.
    """
    low = F.lower(F.col(redacted_col))
    whole = done.select(F.col(doc), low.alias("_whole"))
    if block:
        parts = done.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), low.alias("t")))).alias("p"))
        whole = parts.select(doc, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("_whole"))
    wanted = texts.select(doc, F.trim("text").alias("text")).where("text != ''").distinct()
    return wanted.join(whole, doc).where(F.contains("_whole", F.lower("text"))).select(doc, "text").distinct()


def is_orphan(text: Column) -> Column:
    """Whether a text is only what forms leave beside a blocked place: under four characters, or small words and letters."""
    off = rf"(?U)\A[\s{R.EDGE_SIGNS}]+|[\s{R.EDGE_SIGNS}]+\z"
    bare = F.lower(F.regexp_replace(text, off, ""))
    small = lambda t: t.isin(R.ORPHANS) | (F.length(t) <= 1)
    tokens = F.transform(F.split(bare, r"(?U)\s+"), lambda t: F.regexp_replace(t, off, ""))
    return (F.length(bare) < SHORTEST_RESIDUAL) | F.forall(tokens, small)


def residuals(
    again: DataFrame, rejected: DataFrame, doc: str, dates: str = "block", ages: str = "block", most: int | None = MOST_RESIDUALS, language: str = "language"
) -> DataFrame:
    """Detections of the redacted texts that are neither blocks, nor meant to stand there, nor rejected by somebody.

    Each text once in a document, in any letter case; the first `most` of a document, None for all. Shifted dates and
    age bands are meant to stand there. again has doc, block_id, start, category, text and a language; rejected has doc
    and text.
    """
    low = F.lower(F.trim("text"))
    known = rejected.select(F.col(doc), low.alias("_low")).distinct()
    meant = F.lit(False)
    if dates == "shift":
        meant = meant | (F.col("category") == "date")
    if ages == "band":
        meant = meant | ((F.col("category") == "birth_or_age") & is_age(F.col("text"), F.col(language)))
    odd = F.contains("text", F.lit(BLOCK)) | (F.col("category") == "logo") | is_orphan(F.col("text")) | meant
    fresh = again.withColumn("_low", low).where(~odd).join(known, [doc, "_low"], "left_anti")
    first = F.row_number().over(Window.partitionBy(doc, "_low").orderBy("block_id", "start"))
    once = fresh.withColumn("_n", first).where("_n = 1").drop("_n")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(doc).orderBy("block_id", "start"))
        once = once.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return once.drop("_low")


def audit(found: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """(category, detected, redacted): counts, never values."""
    marks = approvals.select(*keys).distinct().withColumn("_yes", F.lit(1))
    return found.join(marks, keys, "left").groupBy("category").agg(F.count(F.lit(1)).alias("detected"), F.count("_yes").alias("redacted"))


def counted_by_category(found: DataFrame, doc: str) -> DataFrame:
    """(doc, n, by_category): a document's rows, and a map of how many each category has."""
    each = found.groupBy(doc, "category").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(doc).agg(F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "c")))).alias("by_category"))


def audit_records(
    results: DataFrame,
    found: DataFrame,
    approvals: DataFrame,
    left: DataFrame,
    more: DataFrame,
    doc: str,
    categories: list[str],
    custom: int = 0,
    allowed: int = 0,
    terms: int = 0,
    dates: str = "block",
    ages: str = "block",
) -> DataFrame:
    """(doc, record): for each document of results (doc, content, zones) what was done to it, as a struct.

    Counts of detections (found: doc, det_id, category), of approvals (doc, det_id), of leftovers and residuals; the
    sizes of the settings; the SHA-256 of the content. The number of redactions is that of approved detections, zones
    and terms, a term once however often it stands. Never a value, a file's name, or the days of a shift.
    """
    marks = approvals.select(doc, "det_id").distinct().withColumn("_yes", F.lit(1))
    marked = found.select(doc, "det_id", "category").join(marks, [doc, "det_id"], "left")
    each = marked.groupBy(doc, "category").agg(F.count(F.lit(1)).alias("detected"), F.count("_yes").alias("redacted"))
    counts = each.groupBy(doc).agg(
        F.sum("detected").alias("_detected"),
        F.sum("redacted").alias("_approved"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("detected", "redacted").alias("v"))))).alias("_by"),
    )
    rest = counted_by_category(more, doc).select(doc, F.col("n").alias("_residuals"), F.col("by_category").alias("_residual_by"))
    lost = left.groupBy(doc).agg(F.count(F.lit(1)).alias("_left"))
    joined = results.join(counts, doc, "left").join(rest, doc, "left").join(lost, doc, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    settings = F.struct(F.lit(len(categories)).alias("categories"), F.lit(custom).alias("custom_terms"), F.lit(allowed).alias("allowed_terms"))
    done = F.struct(
        (n("_approved") + n("zones") + F.lit(terms)).alias("total"),
        n("_approved").alias("approved"),
        (n("_detected") - n("_approved")).alias("rejected"),
        n("zones").alias("zones"),
        F.lit(terms).alias("terms"),
        F.col("_by").alias("by_category"),
        F.lit("shifted" if dates == "shift" else "blocked").alias("dates"),
        F.lit("banded" if ages == "band" else "blocked").alias("ages"),
    )
    second = F.struct(n("_left").alias("leftovers"), n("_residuals").alias("residuals"), F.col("_residual_by").alias("residuals_by_category"))
    sha = F.sha2(F.col("content").cast("binary"), 256)
    return joined.select(doc, F.struct(settings.alias("settings"), done.alias("redaction"), second.alias("second_pass"), sha.alias("sha256")).alias("record"))


def evaluated(truth: DataFrame, found: DataFrame, doc: str, examples: int = EXAMPLES) -> DataFrame:
    """(category, truths, covered, detections, right, sensitivity, precision, missed), null category for all together.

    A truth is covered by a detection of its category that holds it or lies in it, white space and letter case apart;
    a detection is right if it so meets a truth. Rates are null without support. missed has the first few values by
    alphabet that no detection covers, as many as `examples`.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    a = truth.select(doc, "category", flat(F.col("value")).alias("v"), F.col("value").alias("shown"), F.lit(0).alias("side"))
    b = found.select(doc, "category", flat(F.col("text")).alias("v"), F.lit(None).cast("string").alias("shown"), F.lit(1).alias("side"))
    both = a.unionByName(b).groupBy(doc, "category").agg(
        F.collect_list(F.when(F.col("side") == 0, F.struct("v", "shown"))).alias("_a"), F.collect_list(F.when(F.col("side") == 1, F.col("v"))).alias("_b")
    )  # a document's values of one category are few
    meets = lambda x, y: F.contains(x, y) | F.contains(y, x)
    missed = F.filter("_a", lambda t: ~F.exists("_b", lambda d: meets(t["v"], d)))
    right = F.filter("_b", lambda d: F.exists("_a", lambda t: meets(t["v"], d)))
    counts = both.select("category", F.size("_a").alias("truths"), F.size(missed).alias("lost"), F.size("_b").alias("detections"), F.size(right).alias("right"), F.transform(missed, lambda t: t["shown"]).alias("missed"))
    sums = [F.sum(c).alias(c) for c in ("truths", "lost", "detections", "right")]
    counts = written(counts)  # read twice below, and the detections are not to be made twice
    narrow = counts.select("category", "truths", "lost", "detections", "right")
    total = narrow.rollup("category").agg(*sums).withColumn("covered", F.col("truths") - F.col("lost"))
    shown = counts.where(F.size("missed") > 0).select("category", F.explode("missed").alias("m"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("m"))
    shown = shown.withColumn("_n", rank).where(F.col("_n") <= examples).groupBy("category").agg(F.array_sort(F.collect_list("m")).alias("missed"))
    rates = total.withColumn("sensitivity", F.try_divide("covered", "truths")).withColumn("precision", F.try_divide("right", "detections"))
    return rates.join(shown, "category", "left").select("category", "truths", "covered", "detections", "right", "sensitivity", "precision", "missed")
