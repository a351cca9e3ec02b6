"""How far the sources of a language differ in their use of terms, from hash stripes folded inside the mappers.

Each task folds whole documents into stripes: a term's document frequency and its counts by source. A stripe table
that grows large is spilled as rows. Stripes that many tasks have (a frequent term has one in every task) are merged
within shares of the tasks first, and then all by (language, term); merging adds, so the order doesn't matter. Terms
in enough documents of their language are kept, and their stripes emit everything else:

    q, p       a term's share in the language and in a source, smoothed, in whole billionths
    term rows  where p > q, the largest p - q of each source
    pair rows  for sources a and b the sum of |p_a - p_b| over all kept terms of the language

A kept term that source a doesn't have still has the share z_a there, which is the same for all such terms. So a pair's
sum is V |z_a - z_b|, corrected for the terms that a has, for those that b has, and for those that both have:

    sum over a's terms of |p_a - z_b| - |z_a - z_b|, the same for b, and
    sum over the terms of both of |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|

The first two need only how often each count occurs in a source; the last one is emitted by the stripes, pair by pair of
the sources that a stripe holds, added up in the task. Nothing is emitted for pairs that share no term.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, word_pieces, written

#: A term is a run of ASCII letters and bytes from 128 on; capital letters of ASCII are folded.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRIPES = 300_000  # stripes a task holds before it spills them
SHARED = 16  # documents of a spill that make its stripe one that other tasks are likely to have
PAIRS = 1 << 20  # pairs of sources that are added up at a time
UNIT = 1_000_000_000


def _rows(stripes: dict, share: int) -> pa.RecordBatch:
    dfs, sizes, sources, counts = [], [], [], []
    for stripe in stripes.values():
        dfs.append(stripe.pop(None))
        sizes.append(len(stripe))
        sources += stripe
        counts += stripe.values()
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((sources, pa.string()), (counts, pa.int64()))]
    langs, terms = (pa.array([k[i] for k in stripes], t) for i, t in ((0, pa.string()), (1, pa.binary())))
    shares = np.where(np.array(dfs, np.int64) >= SHARED, share, -1).astype(np.int32)
    return pa.RecordBatch.from_arrays([langs, terms, pa.array(dfs, pa.int64()), *lists, pa.array(shares)], schema=ARROW)


SCHEMA = "lang string, term binary, df long, sources array<string>, counts array<long>, share int"
ARROW = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("share", pa.int32())])


def stripes(docs: DataFrame, shares: int, most: int = STRIPES) -> DataFrame:
    """(lang, term, df, sources, counts, share): stripes of each task, with the task's share where a stripe is a frequent one."""

    def run(batches):
        share = TaskContext.get().partitionId() % shares
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words: Counter = Counter()
                for piece in word_pieces(text, TERMS):
                    words.update(piece)
                for term, n in words.items():
                    stripe = held.get((lang, term))
                    if stripe is None:
                        held[lang, term] = {None: 1, source: n}
                    else:
                        stripe[None] += 1
                        stripe[source] = stripe.get(source, 0) + n
                if len(held) >= most:
                    yield _rows(held, share)
                    held = {}
        yield _rows(held, share)

    return docs.mapInArrow(run, SCHEMA)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where rows of another language, term or share begin."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for name in ("lang", "term", "share"):
        column = rows.column(name)
        new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return np.flatnonzero(np.append(True, new)) if rows.num_rows else np.empty(0, np.int64)


def _put_together(rows: pa.Table, starts: np.ndarray, least: int) -> pa.RecordBatch:
    """One row for each run of rows that begins at the starts, of those with `least` documents in all."""
    rows = rows.combine_chunks()
    df = np.add.reduceat(rows.column("df").to_numpy(), starts) if len(starts) else np.empty(0, np.int64)
    keep = df >= least
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    part = rows.filter(pa.array(keep[run])) if len(starts) and not keep.all() else rows
    number = np.cumsum(keep) - 1  # of the runs that are kept
    sources, counts = (part.column(n).combine_chunks() for n in ("sources", "counts"))
    owner = np.repeat(number[run[keep[run]]], pc.list_value_length(sources).to_numpy())
    coded = pc.dictionary_encode(sources.flatten())
    codes, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    keys, sums = _added(owner * width + codes, counts.flatten().to_numpy())
    offsets = pa.array(np.searchsorted(keys, np.arange(keep.sum() + 1) * width).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(keys % width)), pa.array(sums))]
    first = rows.take(pa.array(starts[keep]))
    share = pa.array(np.full(first.num_rows, -1, np.int32))
    columns = [first.column(n).combine_chunks() for n in ("lang", "term")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(df[keep]), *lists, share], schema=ARROW)


def merged(rows: DataFrame, *more: str, least: int = 0) -> DataFrame:
    """Stripes of one (lang, term) put together, or of one (lang, term, share) where more names that; with `least` documents.

    Rows come sorted, a batch at a time; what the last key of a batch has so far waits as one row for the next batch.
    """

    def run(batches):
        waiting, key = None, None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            if here.num_rows:
                if waiting is not None:
                    back = waiting.set_column(5, "share", pa.array([key], pa.int32()))
                    here = pa.concat_tables([pa.Table.from_batches([back]), here.cast(ARROW)])
                starts = _starts(here)
                key = here.column("share")[-1].as_py()
                last = int(starts[-1])
                if len(starts) > 1:
                    yield _put_together(here.slice(0, last), starts[:-1], least)
                waiting = _put_together(here.slice(last), np.array([0]), 0)
        if waiting is not None and waiting.column("df")[0].as_py() >= least:
            yield waiting

    keyed = rows if more else rows.withColumn("share", F.lit(-1))
    return keyed.repartition("lang", "term", *more).sortWithinPartitions("lang", "term", *more).mapInArrow(run, SCHEMA)


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 count / size), exact for count <= size < 9.2 * 10^15, by three steps of long division."""
    whole, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", rest, size), F.pmod(rest, size)
    return whole + 1


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[firsts], np.add.reduceat(values, firsts) if len(keys) else values


def _within(ids: np.ndarray, p: np.ndarray, z: np.ndarray):
    """(pair, value) of stripes with k sources each, as rows of the arrays; at most PAIRS or one stripe's width at a time."""
    n, k = ids.shape
    rows = max(1, PAIRS // k)
    for at in range(0, n, rows):
        i, a, za = ids[at : at + rows], p[at : at + rows], z[at : at + rows]
        for x in range(k - 1):
            one, other = slice(x, x + 1), slice(x + 1, k)
            value = abs(a[:, one] - a[:, other]) - abs(a[:, one] - za[:, other]) - abs(za[:, one] - a[:, other]) + abs(za[:, one] - za[:, other])
            low, high = np.minimum(i[:, one], i[:, other]), np.maximum(i[:, one], i[:, other])
            yield (low << 32 | high).ravel(), value.ravel()


def _of_both(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) from (lang, sources, p, z): what stripes add to pairs of the sources they hold, by task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def told(sums: dict, names: list[str]):
        for lang, (keys, values) in sums.items():
            low, high = ([names[k] for k in side.tolist()] for side in (keys >> 32, keys & 0xFFFFFFFF))
            columns = [pa.array([lang] * (2 * len(keys)), pa.string()), pa.array(low + high, pa.string()), pa.array(high + low, pa.string()), pa.array(np.tile(values, 2))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        number: dict[str, int] = {}
        names: list[str] = []
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            begins = np.cumsum(sizes) - sizes
            flat = lists.flatten().to_pylist()
            for name in flat:
                if name not in number:
                    number[name] = len(names)
                    names.append(name)
            ids = np.array([number[x] for x in flat], np.int64)
            p, z = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            for lang in set(langs.tolist()):
                for k in set(sizes[langs == lang].tolist()) - {0, 1}:
                    at = begins[(langs == lang) & (sizes == k)][:, None] + np.arange(k)
                    for keys, values in _within(ids[at], p[at], z[at]):
                        before = sums.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                        keys, values = _added(keys, values)
                        sums[lang] = _added(np.concatenate((before[0], keys)), np.concatenate((before[1], values)))
                    if sum(len(x[0]) for x in sums.values()) > PAIRS:
                        yield from told(sums, names)
                        sums = {}
        yield from told(sums, names)

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def _of_one(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) from (lang, source, kept, zero, has, others): what a source's own terms add to each of its pairs.

    has holds (p, n): n of its terms have the share p. Shares are sorted, so that sums of |p - z| are looked up.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        for batch in batches:
            for lang, source, kept, zero, has, others in zip(*(c.to_pylist() for c in batch.columns)):
                names = [o["source"] for o in others if o["source"] != source]
                if not names:
                    continue
                z = np.array([o["zero"] for o in others if o["source"] != source], np.int64)
                p, n = (np.array([h[f] for h in has or []], np.int64) for f in ("p", "n"))
                order = np.argsort(p)
                p, n = p[order], n[order]
                many, total = (np.append(0, np.cumsum(x)) for x in (n, n * p))
                below = np.searchsorted(p, z)
                sums = z * many[below] - total[below] + (total[-1] - total[below]) - z * (many[-1] - many[below])
                apart = abs(z - zero)
                own = sums - many[-1] * apart
                here, there = pa.array([source] * len(names), pa.string()), pa.array(names, pa.string())
                same = pa.array([lang] * len(names), pa.string())
                yield pa.RecordBatch.from_arrays([same, here, there, pa.array(own + kept * apart)], schema=schema)
                yield pa.RecordBatch.from_arrays([same, there, here, pa.array(own)], schema=schema)

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def audited(docs: DataFrame, least: int = 30, top: int = 50, shares: int = 64, most: int = STRIPES, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources and terms by how far their shares are apart.

    Terms in at least `least` documents of their language are kept. Part `pair` has every other source of the language,
    part `term` at most `top` terms that the source has more of than its language; both are ranked by value, then by item.
    A task spills its stripes when it holds `most` of them. Null texts, languages and sources count as empty ones. Rows that repeat count each; very long texts are folded whole;
    ties go by the item's bytes; a group without kept terms has its pairs; an empty table gives an empty result. Other
    columns, whatever their names, aren't read. The result has a row for each pair of sources, and so does a language's
    list of sources, which goes to each of them; nothing else is collected.
    """
    small_batches(docs.sparkSession)
    named = docs.select(
        *(F.coalesce(F.col(f"`{c}`"), F.lit("")).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    folded = written(stripes(named, shares, most))
    together = folded.where("share < 0").unionByName(merged(folded.where("share >= 0"), "share"))
    kept = merged(together, least=least)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    kept = written(kept.select("lang", F.col("term").cast("string").alias("term"), "sources", "counts", total.alias("total")))

    entries = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    smooth = 5 * F.col("kept")
    zero = F.when(F.col("kept") > 0, share(F.lit(5), F.coalesce("size", F.lit(0)) + smooth))
    groups = written(groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("size", F.lit(0)).alias("size"), "lang_size", F.coalesce(zero, F.lit(0)).alias("zero")))

    known = entries.join(groups, ["lang", "source"])
    p, q = share(F.col("n") + 5, F.col("size") + smooth), share(F.col("total") + 5, F.col("lang_size") + smooth)
    known = written(known.select("lang", "source", "term", p.alias("p"), q.alias("q"), "zero"))

    stripe = known.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("s"))
    both = _of_both(stripe.select("lang", "s.source", "s.p", "s.zero"))
    has = known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("has"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("others"))
    one = groups.join(has, ["lang", "source"], "left").join(others, "lang")
    sums = _of_one(one.select("lang", "source", "kept", "zero", "has", "others")).unionByName(both)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = known.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
