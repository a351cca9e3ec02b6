"""Detection of personal data: text blocks -> typed, disjoint spans, in one narrow stage of built-in expressions.

Of every recognizer the spans are found, checked, classified and filtered; the fold over all spans of a block, in
order of place, lets the stronger of two that overlap win without leaving a character uncovered. A text's tokens and
whether it has digits are worked out once; a recognizer's pattern runs only on texts that can match it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velar.functions import checks, spans
from velar.functions.language import language_of, latin_words
from velar.functions.stems import stem, stem_of
from velar.operators import terms
from velar.plans import recognizers as R
from velar.plans.catalog import ALIASES, GROUP_OF

SPAN = "struct<start:int,end:int,category:string,layer:int,score:double,detector:string>"
EMPTY = f"array<{SPAN}>"
SHORTEST, NEAR_TOKENS, NEAR_CHARS, SHORTEST_NAME = 2, 5, 120, 3
SIX_DIGITS = r"\p{Nd}(?:[^\p{L}\p{Nd}]{0,3}\p{Nd}){5}"


def known_categories(categories: Iterable[str] | None) -> list[str]:
    """None: all. Otherwise the known ones among them, by name or alias; unknown ones are left out."""
    if categories is None:
        return list(GROUP_OF)
    asked = {ALIASES.get(c, c) for c in categories}
    return [c for c in GROUP_OF if c in asked]


def span(start, end, category, layer, score, detector) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), category.alias("category"), layer.alias("layer"), score.alias("score"), detector.alias("detector"))


def _moved(s: Column, place: Column) -> Column:
    return span(place["start"], place["end"], s["category"], s["layer"], s["score"], s["detector"])


def _words(values: Iterable[str]) -> Column:
    """A literal array of words."""
    return F.split(F.lit(" ".join(values)), " ")


def features(text: Column, tokens: Column, cues: Iterable[str] = ()) -> Column:
    """struct<cues,n,digits>: what the gates of the recognizers look at; cues are the tokens that recognizers name."""
    known = F.array_distinct(F.filter(tokens, lambda t: t.isin(list(cues))))
    n = F.length(F.regexp_replace(text, r"\P{Nd}+", ""))
    return F.struct(known.alias("cues"), n.alias("n"), text.rlike(SIX_DIGITS).alias("digits"))


def marked(text: str, has: str, wanted: list[R.Recognizer]) -> Column:
    """array<struct<i,text>>: for each recognizer its number and the text with its matches marked, null without any.

    A line end, the match, a line end, the value, a line end stand for a match; a plain text holds no line end itself.
    One SQL text, as building as many Columns piece by piece takes seconds. A column of its own and no part of a
    function over arrays, so that Spark compiles it.
    """
    parts = []
    for i, r in enumerate(wanted):
        if '"' in r.regex():
            raise ValueError(f"{r.name}: a pattern can't hold a quotation mark")
        regex = f'r"{r.regex()}"'
        gates = [f"{has}.n >= {r.least}"] if r.least else []
        if r.gate and r.gate != "digit":
            gates.append(f"{has}.digits" if r.gate == "digits" else f"contains({text}, '{r.gate}')")
        if r.words:
            words = ", ".join(f"'{w}'" for w in r.words)
            gates.append(f"exists({has}.cues, t -> t in ({words}))")
        gates.append(f"{text} rlike {regex}")
        parts.append(f"case when {' and '.join(gates)} then struct({i} as i, regexp_replace({text}, {regex}, '\n$0\n${r.group}\n') as text) end")
    return F.expr(f"array({', '.join(parts)})")


def _places(m: Column) -> Column:
    """array<struct<start,end,i>> of a marked text: gap, match, value, gap, ..., whose lengths add up to places; a value ends its match."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,i:int>>").alias("out"))

    def found(sizes: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            end = acc["at"] + F.get(sizes, k) + F.get(sizes, k + 1)
            place = F.struct((end - F.get(sizes, k + 2)).alias("start"), end.alias("end"), m["i"].alias("i"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], place).alias("out"))

        every = F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 4, F.lit(3)), start, step, lambda acc: acc["out"])
        end = F.get(sizes, F.lit(0)) + F.get(sizes, F.lit(1))
        one = F.array(F.struct((end - F.get(sizes, F.lit(2))).alias("start"), end.alias("end"), m["i"].alias("i")))
        return F.when(F.size(sizes) == 4, one).otherwise(every)

    return spans.let(F.transform(F.split(m["text"], "\n", -1), F.length), found)


def classified(category: Column, text: Column, start: Column, language: str) -> Column:
    """A person behind a clinician's cue is a clinician, a date behind a birth cue is a birth date."""
    before = lambda n: spans.piece(text, F.greatest(start - n, F.lit(0)), start)
    return (
        F.when((category == "person") & before(R.CLINICIAN_REACH).rlike(R.CLINICIAN_BEFORE[language]), "clinician")
        .when((category == "date") & before(R.BIRTH_REACH).rlike(R.BIRTH_BEFORE[language]), "birth_or_age")
        .otherwise(category)
    )


def recognized(text_col: str, marks: Column, wanted: list[R.Recognizer], language: str, categories: list[str]) -> Column:
    """Spans of the recognizers from the texts that marked() made: checked, classified, and above the threshold.

    Each recognizer only adds its marks to the plan; what follows is written once for all of them.
    """
    text = F.col(text_col)
    matches = F.filter(marks, lambda m: m.isNotNull())
    tests = list(dict.fromkeys(r.check for r in wanted if r.check))

    def stems_of(r: R.Recognizer) -> list[str]:
        return sorted({stem_of(w, language) for w in r.near})

    listed = lambda words: "split('" + " ".join(words) + "', ' ')" if words else "cast(array() as array<string>)"
    known = [
        f"named_struct('name', '{r.name}', 'category', '{r.category}', 'score', {r.score}d, 'sure', {str(r.sure).lower()}, 'test', {tests.index(r.check) if r.check else -1}, 'near', {listed(r.near)}, 'stems', {listed(stems_of(r))})"
        for r in wanted
    ]
    table = F.expr(f"array({', '.join(known)})")  # a literal: what the recognizers say, by number

    def passes(test: Column, value: Column) -> Column:
        """Whether the value passes one of its recognizer's tests; one without tests passes."""
        out = F.when(test < 0, True)
        for i, names in enumerate(tests):
            some = checks.CHECKS[names[0]](value)
            for c in names[1:]:
                some = some | checks.CHECKS[c](value)
            out = out.when(test == i, some)
        return out

    def near(r: Column, start: Column) -> Column:
        """Whether a context word of its recognizer is part of one of the tokens just before, or a form of one."""
        parts = lambda a: F.split(F.lower(F.trim(spans.piece(text, a, start))), r"\s+")
        close = parts(F.greatest(start - NEAR_CHARS, F.lit(0)))
        # all tokens but the first of a cut are whole; where these are too few, the whole text before is cut into tokens
        enough = lambda t: F.when((F.size(t) > NEAR_TOKENS) | (start <= NEAR_CHARS), t).otherwise(parts(F.lit(0)))
        tokens = F.slice(F.reverse(spans.let(close, enough)), 1, NEAR_TOKENS)
        alike = lambda t: F.exists(r["near"], lambda w: F.contains(t, w)) | F.array_contains(r["stems"], stem(t, language))
        return (F.size(r["near"]) > 0) & F.exists(tokens, alike)

    def judged(s: Column) -> Column:
        def by(r: Column) -> Column:
            raised = F.least(F.greatest(r["score"] + R.BOOST, F.lit(R.BOOSTED)), F.lit(1.0))
            score = F.round(F.when(r["sure"], 1.0).when(near(r, s["start"]), raised).otherwise(r["score"]), 2)
            stands = (s["start"] < s["end"]) & spans.let(spans.piece(text, s["start"], s["end"]), lambda v: passes(r["test"], v))
            category = classified(r["category"], text, s["start"], language)
            return F.when(stands, span(s["start"], s["end"], category, F.lit(1), score, r["name"]))

        return spans.let(F.get(table, s["i"]), by)

    found = F.transform(F.flatten(F.transform(matches, _places)), judged)
    return F.filter(found, lambda s: s["category"].isin(categories) & (s["score"] >= R.THRESHOLD))


def _could(r: R.Recognizer, categories: list[str]) -> bool:
    also = {"person": "clinician", "date": "birth_or_age"}.get(r.category)
    return r.category in categories or also in categories


def wanted_of(language: str, categories: list[str]) -> list[R.Recognizer]:
    """The recognizers of a language that can give an asked category; only those are built into the plan."""
    return [r for r in (R.ENGLISH if language == "en" else R.SPANISH) if _could(r, categories)]


def all_spans(text_col: str, marks: Column, language: str, categories: list[str], custom: list[str]) -> Column:
    """Spans of all recognizers of a language that can give an asked category."""
    wanted = wanted_of(language, categories)
    # asked twice, so that the marks stay a column of their own
    parts = [F.when(F.size(marks) > 0, recognized(text_col, marks, wanted, language, categories)).otherwise(F.array().cast(EMPTY))] if wanted else []
    listed = sorted({t.strip() for t in custom if t and t.strip()}, key=lambda t: (-len(t), t))
    if listed and "custom_term" in categories:
        pattern = r"(?iuU)(?<!\w)(?:" + "|".join(spans.literal(t, False) for t in listed) + r")(?!\w)"
        own = lambda s: span(s["start"], s["end"], F.lit("custom_term"), F.lit(1), F.lit(1.0), F.lit("custom"))
        parts.append(F.transform(spans.find_all(F.col(text_col), pattern), own))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(EMPTY)


def outside_spans(text: Column, found: Column, language: str, categories: list[str], allow: list[str]) -> Column:
    """Spans of a second layer (named entities of some model) made fit to join the first layer's.

    They are classified and filtered like those, lose words of forms and single allowed words at their ends, and go if
    fewer than three characters, a word of forms, or fewer letters than half of what is left.
    """
    singles = [a for a in allow if " " not in a]

    def fit(s: Column) -> Column:
        category = classified(s["category"], text, s["start"], language)
        place = spans.without_edges(text, s["start"], s["end"], R.NOISE[language] + singles, R.EDGE_SIGNS)
        return spans.let(place, lambda t: span(t["start"], t["end"], category, F.lit(2), F.round(F.least(s["score"], F.lit(1.0)), 2), s["detector"]))

    def stands(s: Column) -> Column:
        bare = F.lower(F.regexp_replace(spans.piece(text, s["start"], s["end"]), rf"(?U)\A[\s{R.EDGE_SIGNS}]+|[\s{R.EDGE_SIGNS}]+\z", ""))
        letters = F.length(F.regexp_replace(bare, r"\P{L}", ""))
        size = F.length(bare)
        return s["category"].isin(categories) & (s["score"] >= R.THRESHOLD) & (size >= SHORTEST_NAME) & ~bare.isin(R.NOISE[language]) & (letters * 2 >= size)

    return F.filter(F.transform(found, fit), stands)


def resolved(text: Column, found: Column) -> Column:
    """Spans of which the stronger won, from overlapping ones.

    Sorted by start, longest first, each meets the last one kept. Apart: both stay. Same category: they become one.
    Otherwise the one with the lower layer, then the higher score, then the greater length wins whole, and what the
    other one covers beyond it stays as a remnant, without outer white space, if it has two characters. As only the last one kept is looked
    at, three or more that overlap each other may leave two that still do; edits are made from left to right.
    """
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["layer"].alias("c"), (-s["score"]).alias("d"), s["detector"].alias("e"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["s"])
    none = F.array().cast(EMPTY)

    def remnant(s: Column, start: Column, end: Column) -> Column:
        cut = F.transform(F.array(spans.trimmed(text, start, F.greatest(start, end))), lambda t: _moved(s, t))
        return F.filter(cut, lambda x: x["end"] - x["start"] >= SHORTEST)

    def rank(s: Column) -> Column:
        return F.struct((-s["layer"]).alias("l"), s["score"].alias("s"), (s["end"] - s["start"]).alias("n"))

    def step(acc: Column, d: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        rest = F.slice(acc, F.lit(1), F.size(acc) - 1)
        union = span(last["start"], F.greatest(last["end"], d["end"]), last["category"], F.least(last["layer"], d["layer"]), F.greatest(last["score"], d["score"]), last["detector"])
        wins = F.concat(rest, remnant(last, last["start"], d["start"]), F.array(d), remnant(last, d["end"], last["end"]))
        return (
            F.when((F.size(acc) == 0) | (d["start"] >= last["end"]), F.array_append(acc, d))
            .when(d["category"] == last["category"], F.array_append(rest, union))
            .when(rank(d) > rank(last), wins)
            .otherwise(F.concat(acc, remnant(d, last["end"], d["end"])))
        )

    return F.when(F.size(found) < 2, found).otherwise(F.aggregate(ordered, none, step))


def cleaned(text: Column, found: Column, language: Column) -> Column:
    """Spans without labels, particles and signs at their ends; custom terms stay whole; short rests go."""
    words = {k: R.EDGE_WORDS + R.NOISE[k] for k in R.NOISE}

    def clean(s: Column) -> Column:
        edges = {k: spans.without_edges(text, s["start"], s["end"], words[k], R.EDGE_SIGNS) for k in words}
        cut = F.when(language == "en", edges["en"]).otherwise(edges["es"])
        return F.when(s["category"] == "custom_term", s).otherwise(spans.let(cut, lambda t: _moved(s, t)))

    return F.filter(F.transform(found, clean), lambda s: s["end"] - s["start"] >= SHORTEST)


def context(text: Column, start: Column, end: Column, radius: int = R.CONTEXT_RADIUS) -> Column:
    """What stands around a span, cut at word borders, with an ellipsis where it was cut."""
    left, right = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    head = F.when(left > 0, F.concat(F.lit("…"), F.regexp_replace(spans.piece(text, left, start), r"\A\S*\s", ""))).otherwise(spans.piece(text, left, start))
    tail = F.when(right < F.length(text), F.concat(F.regexp_replace(spans.piece(text, end, right), r"\s\S*\z", ""), F.lit("…"))).otherwise(spans.piece(text, end, right))
    return F.concat(head, spans.piece(text, start, end), tail)


def plain(text: Column) -> Column:
    """Line ends and tabs as spaces, one for one, so that places stay."""
    return F.translate(text, "\r\n\t", "   ")


def with_spans(
    blocks: DataFrame,
    categories: Iterable[str] | None = None,
    custom: Iterable[str] = (),
    allow: Iterable[str] = (),
    text_col: str = "text",
    language_col: str | None = None,
    named: str | None = None,
    proposed: str | None = None,
    own_terms: DataFrame | None = None,
    allow_terms: DataFrame | None = None,
) -> DataFrame:
    """blocks with `language` and `spans`: the disjoint detections of each text. No shuffle, no Python.

    language_col holds 'es' or 'en' (others count as 'es'); without it each text decides for itself. categories None
    asks for all of them, an empty list for none. allow holds whole texts, in any case, that are never detections.
    named and proposed are columns of spans of further layers, array<SPAN>: named entities of a model (layer 2) join the
    recognizers' spans; proposals of a language model (layer 3, see operators.layers) are resolved against the outcome.
    own_terms and allow_terms are tables of terms (column `term`) that do what custom and allow do, in one pass over the
    texts and with a plan that doesn't grow with them. Null and blank texts have no detections.
    """
    if own_terms is not None:
        blocks = terms.with_places(blocks, own_terms, "_own", text_col, whole=True)
    if allow_terms is not None:
        blocks = terms.with_places(blocks, allow_terms, "_allowed", text_col, overlapping=True)
    chosen = tuple(known_categories(categories))
    allowed = tuple(sorted({a.strip().lower() for a in allow if a and a.strip()}))
    built = _expressions(blocks.sparkSession.sparkContext.applicationId, chosen, tuple(custom), allowed, bool(named), bool(proposed), own_terms is not None, allow_terms is not None)
    none = F.array().cast(EMPTY)
    base = blocks.withColumn("_plain", plain(F.col(text_col))).withColumns({f"_{k}": F.coalesce(F.col(c), none) for k, c in (("named", named), ("proposed", proposed)) if c})
    base = base.withColumn("_tokens", latin_words(F.col("_plain")))
    base = base.withColumn("_has", features(F.col("_plain"), F.col("_tokens"), sorted({w for k in R.NOISE for r in wanted_of(k, list(chosen)) for w in r.words})))
    language = F.col(language_col) if language_col else language_of(F.col("_tokens"), F.col(text_col))
    base = base.withColumn("language", F.when(language == "en", "en").otherwise("es"))
    for name, expression in built:
        base = base.withColumn(name, expression)
    return base.drop("_plain", "_tokens", "_has", "_named", "_proposed", "_marks", "_raw", "_kept", "_all", "_own", "_allowed")


@lru_cache(64)
def _expressions(application: str, categories: tuple[str, ...], custom: tuple[str, ...], allowed: tuple[str, ...], named: bool, proposed: bool, own: bool, places: bool) -> list[tuple[str, Column]]:
    """The columns that with_spans() adds one after another; kept, as building them takes a second or more.

    They read _plain, _has, language, _named and _proposed. application, an id that isn't given twice, tells one Java process from another.
    """
    text, language, none = F.col("_plain"), F.col("language"), F.array().cast(EMPTY)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""

    def of(k: str) -> Column:
        found = all_spans("_plain", F.col("_marks"), k, list(categories), list(custom))
        if own and "custom_term" in categories:
            found = F.concat(found, F.transform("_own", lambda s: span(s["start"], s["end"], F.lit("custom_term"), F.lit(1), F.lit(1.0), F.lit("custom"))))
        return F.concat(found, outside_spans(text, F.col("_named"), k, list(categories), list(allowed))) if named else found

    es, en = (marked("_plain", "_has", wanted_of(k, list(categories))) for k in ("es", "en"))
    marks = F.when(~blank, F.when(language == "en", en).otherwise(es))
    raw, found = F.when(blank, none).when(language == "en", of("en")).otherwise(of("es")), F.col("_raw")
    if allowed:
        found = F.filter(found, lambda s: ~F.lower(F.trim(spans.piece(text, s["start"], s["end"]))).isin(*allowed))
    if places:
        is_allowed = lambda s: spans.let(spans.trimmed(text, s["start"], s["end"]), lambda t: F.exists("_allowed", lambda p: (p["start"] == t["start"]) & (p["end"] == t["end"])))
        found = F.filter(found, lambda s: ~is_allowed(s))
    clean = cleaned(text, F.col("_kept"), language)
    out = [("_marks", marks), ("_raw", raw), ("_kept", resolved(text, found)), ("spans", clean)]
    if proposed:
        more = F.filter(F.col("_proposed"), lambda s: s["category"].isin(*categories))
        out += [("_all", F.when(blank, F.col("spans")).otherwise(F.concat("spans", more))), ("_kept", resolved(text, F.col("_all"))), ("spans", clean)]
    return out


def exploded(found: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per detection of with_spans(): keys, language, start, end, category, layer, score, detector, text, context.

    Rows without a detection are generated as null and dropped after: a plain explode would have the optimizer test the
    number of detections below, and so find them all twice.
    """
    rows = found.select(*keys, "language", F.col(text_col).alias("_text"), F.explode_outer("spans").alias("s")).where("s is not null")
    value = spans.piece(F.col("_text"), F.col("s.start"), F.col("s.end"))
    return rows.select(*keys, "language", "s.*", value.alias("text"), context(plain(F.col("_text")), F.col("s.start"), F.col("s.end")).alias("context"))


def detections(blocks: DataFrame, keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """One row per detection: keys, language, start, end, category, layer, score, detector, text, context."""
    used = [options[k] for k in ("language_col", "named", "proposed") if options.get(k)]
    narrow = blocks.select(*dict.fromkeys([*keys, text_col, *used]))
    return exploded(with_spans(narrow, text_col=text_col, **options), keys, text_col)
