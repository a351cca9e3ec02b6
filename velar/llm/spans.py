"""Substring deduplication on a compacted De Bruijn graph of word windows.

A window of `width` words is an edge from its first width - 1 words to its last width - 1 words. Windows that may
repeat in another document form the graph; along a path whose inner nodes have one way in and one way out, all edges
occur in the same documents, so a path is compared once instead of each of its windows.

1. Documents are dealt into chunks. Each chunk gives the minimizers of its windows (the least hash of the seven 7-word
   sequences in a window; equal windows have equal ones), a row for each value; a window over the values says which
   occur in more than one document. Only windows with such a minimizer go on: whether one does depends on its words
   alone, so that equal windows go on everywhere or nowhere.
2. Each chunk gives the nodes of those windows with one hash of the words before and after; where a run begins or ends,
   a mark stands for the word. A window over the nodes says which branch: different words before, or after.
3. Each chunk cuts its runs at branching nodes. What remains are the compacted paths: as every document that has one of
   their windows has the path, in full, a path is known by a 128-bit hash of its words, read at their coordinates.
4. Paths are joined on that hash: those that a smaller document id also has are the spans to remove.

A hot value or node has one row for each chunk, never one for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, quoted, small_batches, unpacked, word_pieces, written

MINIMIZER = 7
CHUNK_BYTES, FEWEST_CHUNKS = 8 << 20, 48
BRANCH = 1  # tag of a node that is known to branch
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n words, by their start."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * _MIX + h[i : i + size]
    return _mixed(out)


def _words(text: bytes) -> list[bytes]:
    return [w for piece in word_pieces(text, None) for w in piece]


class Chunk:
    """The words of a chunk's documents in one row: hashes, and where each document begins and ends.

    Documents without an id or a window are left out.
    """

    def __init__(self, table: pa.Table, width: int) -> None:
        self.number = table.column("chunk")[0].as_py()
        digest, parts, self.rows, ids, marks, at = xxhash.xxh3_64_intdigest, [], [], [], [], [0]
        row = 0
        for batch in table.select(["id", "text", "mark"]).to_batches():
            for k, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = _words(text.as_py() or b"") if k is not None else []
                if len(words) >= width:
                    parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                    ids.append(k)
                    marks.append(mark)
                    at.append(at[-1] + len(words))
                    self.rows.append(row)
                row += 1
        self.table, self.width = table, width
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.ids, self.marks, self.at = (np.array(x, np.int64) for x in (ids, marks, at))
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.at))
        size = max(0, len(self.hashes) - width + 1)
        gram, least = _grams(self.hashes, MINIMIZER), np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(width - MINIMIZER + 1):
            least = np.minimum(least, gram[i : i + size])
        self.least = least
        self.whole = self.owner[:size] == self.owner[width - 1 : width - 1 + size]  # the window is inside one document

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """Different minimizers, sorted, and whether more than one document of the chunk has them."""
        v, d = self.least[self.whole], self.ids[self.owner[: len(self.least)][self.whole]]
        order = np.argsort(v, kind="stable")
        v, d = v[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        if not len(v):
            return v, np.zeros(0, bool)
        return v[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run of windows whose minimizer is among repeated (sorted)."""
        good = self.whole & _among(self.least, repeated)
        own = self.owner[: len(good)]
        edge = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        starts = np.flatnonzero(good & (edge | ~np.concatenate(([False], good[:-1]))))
        last = np.concatenate((edge[1:], [True])) if len(own) else np.zeros(0, bool)
        ends = np.flatnonzero(good & (last | ~np.concatenate((good[1:], [False]))))
        return starts, ends

    def nodes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the runs' nodes and their hashes."""
        counts = ends - starts + 2
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return at, _grams(self.hashes, self.width - 1)[at] if len(at) else np.zeros(0, np.uint64)

    def branches(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different nodes, sorted, each with one hash of the words before and after; BRANCH where it has several here."""
        starts, ends = self.runs(repeated)
        at, node = self.nodes(starts, ends)
        if not len(node):
            return node, node
        before, after = self.hashes[at - 1] | np.uint64(2), self.hashes[np.minimum(at + self.width - 1, len(self.hashes) - 1)] | np.uint64(2)
        firsts = np.concatenate(([0], np.cumsum(ends - starts + 2)))
        before[firsts[:-1]], after[firsts[1:] - 1] = 0, 0
        tag = _mixed(before * _MIX + after) | np.uint64(2)
        order = np.argsort(node, kind="stable")
        node, tag = node[order], tag[order]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        many = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
        return node[first], np.where(many, np.uint64(BRANCH), tag[first])

    def paths(self, repeated: np.ndarray, branching: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document id, hash of its text, first word and number of words of each compacted path."""
        starts, ends = self.runs(repeated)
        at, node = self.nodes(starts, ends)
        cut = _among(node, branching)
        firsts = np.concatenate(([0], np.cumsum(ends - starts + 2)))
        cut[firsts[:-1]] = True
        cut[firsts[1:] - 1] = False  # the node after a run's last window begins no window
        inner = np.flatnonzero(cut)
        begin = at[inner]
        run = np.searchsorted(starts, begin, "right") - 1
        follows = np.concatenate((run[1:] == run[:-1], [False])) if len(run) else np.zeros(0, bool)
        stop = np.where(follows, np.concatenate((begin[1:], [0])) - 1, ends[run]) if len(run) else begin
        owner, size = self.owner[begin], stop - begin + self.width
        keys, words, have = [], [], -1
        column = self.table.column("text")
        for k, s, n in zip(owner.tolist(), (begin - self.at[owner]).tolist(), size.tolist()):
            if k != have:
                words, have = _words(column[self.rows[k]].as_py()), k
            keys.append(xxhash.xxh3_128_digest(b" ".join(words[s : s + n])))
        return keys, self.ids[owner], self.marks[owner], begin - self.at[owner], size


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def paths(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, mark, start, size): the compacted paths of windows that may repeat, at their places in words; mark is a hash of
    the whole text, which tells rows of one id apart.
    """
    if width < MINIMIZER + 1:
        raise ValueError(f"width must be over {MINIMIZER}")
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    total = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(FEWEST_CHUNKS, -(-total // CHUNK_BYTES))
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).withColumn("mark", F.xxhash64("text"))

    def numbers(n: int, chunk: Chunk) -> pa.Array:
        return pa.array(np.full(n, chunk.number, np.int32))

    def first(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, width)
        value, many = chunk.values()
        return pa.table({"chunk": numbers(len(value), chunk), "value": pa.array(value.view(np.int64)), "many": pa.array(many)})

    def second(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["chunk", "value", "tag"])
        chunk = Chunk(table, width)
        columns = chunk.branches(_known(told, 0))
        return pa.table([numbers(len(columns[0]), chunk), *[pa.array(x.view(np.int64)) for x in columns]], names=["chunk", "value", "tag"])

    def third(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["key", "id", "mark", "start", "size"]
        if not table.num_rows or not told.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), *[pa.int64()] * 4)], names=names)
        key, *places = Chunk(table, width).paths(_known(told, 0), _known(told, 1))
        return pa.table([pa.array(key, pa.binary()), *[pa.array(x) for x in places]], names=names)

    by_chunk, same = dealt.groupBy("chunk"), Window.partitionBy("value")
    asked = by_chunk.applyInArrow(first, "chunk int, value long, many boolean")
    shared = (F.count(F.lit(1)).over(same) > 1) | F.max("many").over(same)
    repeats = asked.withColumn("shared", shared).where("shared").select("chunk", "value", F.lit(0).alias("kind"))
    nodes = by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(second, "chunk int, value long, tag long")
    differ = (F.min("tag").over(same) != F.max("tag").over(same)) | F.max(F.col("tag") == BRANCH).over(same)
    branching = nodes.withColumn("branches", differ).where("branches").select("chunk", "value", F.lit(1).alias("kind"))
    return by_chunk.cogroup(repeats.unionByName(branching).groupBy("chunk")).applyInArrow(third, "key binary, id long, mark long, start long, size long")


def _known(told: pa.Table, kind: int) -> np.ndarray:
    value = told.column("value").to_numpy().view(np.uint64)
    return np.sort(value[told.column("kind").to_numpy() == kind])


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, start, size, first_id): spans of words whose windows all begin in first_id as well, a smaller id.

    The first places are written before the join, whose two sides are then plain exchanges: adaptive execution splits
    a path that stands in very many places.
    """
    found = written(paths(docs, width, id_col, text_col))
    first = found.groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("z")).where("first_id < z").drop("z")
    return found.join(written(first), "key").where("id > first_id").select("id", "mark", "start", "size", "first_id")


def deduplicated(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with all its columns and rows, whatever their names; the text is its words that stay, joined by one space.

    A word goes if it lies in a window of `width` words that also begins in a document with a smaller id. With `counts`
    two columns more, _words and _removed, count words; columns of docs with these names give way. id_col must be a whole number. Rows that repeat an id are one document to each other: their
    windows don't repeat by that alone. Rows without an id neither lose words nor take them. Null text stays null. Very
    long texts are read whole. An empty table gives an empty result.
    """
    docs = docs.drop("_words", "_removed") if counts else docs
    spans = repeated_spans(docs, width, id_col, text_col)
    by_id = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    source = docs.select(packed(docs, text_col).alias("row"), F.col(quoted(id_col)).cast("long").alias("key"), F.col(quoted(text_col)).cast("binary").alias("text"))
    same = (F.col("key") == F.col("id")) & (F.xxhash64("text") == F.col("mark"))
    joined = source.join(by_id, same, "left").select("row", "text", "gone")

    def run(batches):
        for batch in batches:
            out, n, removed = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                words = _words(text or b"")
                n.append(len(words))
                stays = np.ones(len(words), bool)
                for x in gone or ():
                    stays[x["start"] : x["start"] + x["size"]] = False
                kept = [w for w, s in zip(words, stays.tolist()) if s] if gone else words
                removed.append(len(words) - len(kept))
                out.append(None if text is None else b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "_words", "_removed"])

    schema = StructType([joined.schema["row"], joined.schema["text"]]).add("_words", "long").add("_removed", "long")
    cleaned = joined.mapInArrow(run, schema)
    return cleaned.select(*unpacked(docs, text_col), *(["_words", "_removed"] if counts else []))
