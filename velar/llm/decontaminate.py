"""Benchmark decontamination with one FM-index per training shard.

A shard is one batch of documents. Words outside the benchmark's vocabulary can't be part of a phrase: they cut the
shard into runs, and runs shorter than the shortest phrase hold none. The remaining runs, as word numbers with a
separator between them, are indexed; all test phrases are searched backwards through wavelet-tree ranks, occurrences
are located from sampled suffix positions, and their spans are merged per document.

Phrases come in blocks of bounded size (block_bytes of benchmark text). One block at a time is on the driver and is sent
to the tasks, and is searched in a pass of its own; between passes what was found is written and read again. Nothing is
shuffled. A benchmark of any size gives the same result, with a pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LETTERS, binaries, packed, quoted, scratch, small_batches, unpacked, word_pieces, written
from .fm_index import FMIndex

SEPARATOR, FIRST = 1, 2


class Phrases:
    """Distinct windows of items: `width` consecutive words; an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        found: dict[tuple[int, ...], int] = {}
        for name, text in items:
            words = [w for piece in word_pieces(text, LETTERS) for w in piece]
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                at = found.setdefault(tuple(ids[i : i + width]), len(found))
                if at == len(self.items):
                    self.items.append([])
                if name is not None and name not in self.items[at]:
                    self.items[at].append(name)
        self.patterns = [np.array(p, np.int64) for p in found]
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.shortest = int(self.lengths.min(initial=1 << 30))

    def runs(self, text: bytes) -> tuple[int, list[tuple[int, np.ndarray]]]:
        """Number of words, and the runs of known words that are long enough, with the position of their first."""
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, p, repeat(SEPARATOR)), np.int64, len(p)) for p in word_pieces(text, LETTERS)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids != SEPARATOR, [False]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        return len(ids), [(s, ids[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]

    def search(self, texts: list[bytes]) -> tuple[list[int], list[tuple[np.ndarray, set[str]] | None]]:
        """Of one shard: each text's number of words, and its spans (start, end) in words with the items found."""
        sizes, parts, owners, firsts, at, where = [], [], [], [], 0, []
        for k, text in enumerate(texts):
            n, runs = self.runs(text)
            sizes.append(n)
            for first, ids in runs:
                parts += (ids, np.array([SEPARATOR]))
                owners.append(k)
                firsts.append(first)
                where.append(at)
                at += len(ids) + 1
        hits: list = [None] * len(texts)
        if not parts or not self.patterns:
            return sizes, hits
        index = FMIndex(np.concatenate(parts), len(self.vocabulary) + FIRST)
        low, high = index.search(self.patterns)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        position = index.locate(rows)
        run = np.searchsorted(np.array(where), position, "right") - 1
        owner = np.array(owners)[run]
        start = np.array(firsts)[run] + position - np.array(where)[run]
        order = np.argsort(owner, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
            spans = np.stack((start[part], start[part] + self.lengths[which[part]]), 1)
            names = {name for p in np.unique(which[part]).tolist() for name in self.items[p]}
            hits[owner[part[0]]] = (spans, names)
        return sizes, hits


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, in order, that cover the same words; spans that touch become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.stack((spans[new, 0], reach[last]), 1)


SPANS = "array<struct<start:int,end:int>>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[int, list]]:
    """How many blocks follow, and the items (name, text) of each block of about block_bytes, one block after another."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:
        path = scratch(benchmark.sparkSession)
        items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).write.partitionBy("block").parquet(path)
        items = benchmark.sparkSession.read.parquet(path)
    for k in range(n):
        part = items.where(F.col("block") == k) if n > 1 else items
        rows = part.select("item", "text").collect()  # block_bytes, as far as hashes deal evenly
        yield n - 1 - k, sorted(((r["item"], bytes(r["text"])) for r in rows), key=lambda x: (x[0] or "", x[1]))


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_bytes: int = 8 << 20,
    cutting: bool = False,
) -> DataFrame:
    """(id_col, n_words, spans, items): per row of docs the merged spans of words that test phrases cover.

    items lists, in order as strings, the items with a window in the text. Null text has no words; an item without
    words or with null text has no windows; a null item id is searched but not named. Repeated rows each get a row;
    phrases found at one place by several items name each. An empty benchmark finds nothing, empty docs give no rows.
    Very long texts are searched whole. Other columns are not read. With cutting there is also the text, binary, without
    the words of the spans.
    """
    small_batches(docs.sparkSession)
    out = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("binary").alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    spark = docs.sparkSession
    for left, items in _blocks(benchmark, item_col, text_col, block_bytes):
        held = spark.sparkContext.broadcast(Phrases(items, width))
        names = ["id", "n_words", "spans", "items", *(["text"] if left or cutting else [])]
        schema = StructType([out.schema[c] for c in names[:4]])

        def run(batches, held=held, cutting=cutting and not left, names=names):
            for batch in batches:
                whole = batch.column(1)
                sizes, hits = held.value.search(binaries(whole))
                spans, items = [], []
                for hit, old, known in zip(hits, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    if hit is not None:
                        all_ = np.concatenate((hit[0], np.array([(s["start"], s["end"]) for s in old], np.int64).reshape(-1, 2)))
                        old = [{"start": a, "end": b} for a, b in merged(all_).tolist()]
                        known = sorted({*hit[1], *known})
                    spans.append(old)
                    items.append(known)
                kinds = [batch.schema.field(i).type for i in (3, 4)]
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1])]
                if cutting:
                    whole = pa.array([cut(t.as_py(), [(s["start"], s["end"]) for s in x]) if x else t.as_py() for t, x in zip(whole, spans)], whole.type)
                yield pa.RecordBatch.from_arrays([*columns, whole][: len(names)], names=names)

        out = out.select("id", "text", "n_words", "spans", "items").mapInArrow(run, schema.add("text", "binary") if len(names) > 4 else schema)
        if left:
            out = written(out)
            held.destroy()
    return out.withColumnRenamed("id", id_col)


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans; what stands between kept words stays as it is."""
    flat = data.translate(LETTERS)
    keep, at, word, k, out = 0, 0, 0, 0, []
    size = len(flat)
    while k < len(spans) and at < size:
        while at < size and flat[at] == 32:
            at += 1
        end = flat.find(b" ", at)
        end = size if end < 0 else end
        if word == spans[k][0]:
            out.append(data[keep:at])
        if word == spans[k][1] - 1:
            keep, k = end, k + 1
        word, at = word + 1, end
    return b"".join(out) + data[keep:]


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with all its columns and rows, whatever their names, the spans of test phrases cut from the text.

    Other texts are untouched, null ones stay null; rows that repeat each stay; spans that meet are cut as one. Very
    long texts are searched whole. An empty table gives an empty result. The row's other columns travel as one struct,
    so that names can't clash and no join is needed.
    """
    text_col = options.get("text_col", "text")
    source = docs.select(packed(docs, text_col).alias("row"), F.col(quoted(text_col)).alias("text"))
    found = occurrences(source, benchmark, **{**options, "id_col": "row", "text_col": "text", "cutting": True})
    return found.select(*unpacked(docs, text_col))
