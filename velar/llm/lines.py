"""Line deduplication by a segment-partition edit join.

Lines (split at \\n, outer white space off, blank ones left out) are alike if equal, or if both have `least` characters
and at most `most` edits lie between them. Classes are connected components; the line at the smallest (doc_id, line
number) of a class stays, its others go.

A line is cut into most + 1 segments; two lines within `most` edits share one unchanged. Every line is indexed under
its length and segments and probes those substrings that could be another line's segment; rows of one hash meet in
one partition, sorted, and are paired there as a stream. A row carries which of 64 classes of characters the line has:
an edit changes two of them at most, so that most pairs that only share a segment go at once. Pairs are verified by edit
distance on the lines themselves, fetched by their coordinates.

A hash with more than `dense` lines isn't paired out. Its lines are dealt into blocks of about BLOCK_LINES, each two
blocks meet in a task, and there a line is compared with those that nothing has joined yet, by counts of characters
first: what a task holds is bounded, no pair that could join two classes is left out, and lines that are alike cost a
linear number of comparisons. Only a dense hash whose lines are mostly not alike costs the square of its lines.

Equal lines are equal by 128 bits of hash. Candidates are named by 64 of them; where two different lines share those,
one of the two isn't looked at for edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binaries, packed, quoted, small_batches, texts, unpacked, written
from .edits import alike, character_classes, signatures, within
from .graph import components

BLOCK_LINES = 2000


def _keys(line: bytes) -> tuple[int, int]:
    """128 bits of hash as two signed longs."""
    digest = xxhash.xxh3_128_digest(line)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def split(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, line without outer white space) of each line that isn't blank."""
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip():
            yield i, line


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, h, g): every line that isn't blank, by its number and the two halves of its hash."""
    kind, digest = dict(docs.select(F.col(id_col)).dtypes)[id_col], xxhash.xxh3_128_digest

    def run(batches):
        for batch in batches:
            owner, number, keys = [], [], []
            for k, text in enumerate(binaries(batch.column(1))):
                for i, line in split(text):
                    owner.append(k)
                    number.append(i)
                    keys.append(digest(line))
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            h, g = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(h), pa.array(g)], names=["id", "line", "h", "g"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return source.mapInArrow(run, f"id {kind}, line int, h long, g long")


def signature_table(docs: DataFrame, most: int, least: int, text_col: str = "text") -> DataFrame:
    """(sig, h, probe, has): the hashes under which each line is indexed (probe 0) or looks (1), and its classes of
    characters, once per task and line.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sig, key, probe, has = [], [], [], []
            for text in binaries(batch.column(0)):
                for _, raw in split(text):
                    if len(raw) < least:
                        continue
                    h = _keys(raw)[0]
                    if h in seen:
                        continue
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(h)
                    line = raw.decode(errors="replace")
                    if len(line) < least:
                        continue
                    index, probes = signatures(line, most, least)
                    n = len(index) + len(probes)
                    sig += index + probes
                    key += [h] * n
                    probe += [0] * len(index) + [1] * len(probes)
                    has += [character_classes(line)] * n
            columns = [pa.array(sig, pa.int64()), pa.array(key, pa.int64()), pa.array(probe, pa.int8()), pa.array(np.array(has, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "h", "probe", "has"])

    return texts(docs, text_col=text_col).mapInArrow(run, "sig long, h long, probe byte, has long")


def candidates(signed: DataFrame, most: int, dense: int) -> DataFrame:
    """(a, b, sig): pairs of lines that meet under a hash, one of them indexed there, whose characters allow it, without
    sig; and the members a of dense hashes, with sig and without b.

    Reads each partition sorted by hash; what it holds at a time is a batch and at most `dense` rows of a hash.
    """

    def pairs(sig, h, probe, has):
        a, b = [], []
        for step in range(1, len(sig)):
            same = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(same):
                break
            near = np.bitwise_count((has[same] ^ has[same + step]).view(np.uint64)) <= 2 * most
            good = same[near & (h[same] != h[same + step]) & ((probe[same] == 0) | (probe[same + step] == 0))]
            a.append(np.minimum(h[good], h[good + step]))
            b.append(np.maximum(h[good], h[good + step]))
        return np.concatenate(a) if a else h[:0], np.concatenate(b) if b else h[:0]

    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        full = None  # the hash at hand if it is known to be dense
        state: dict = {}

        def cut(rows, full, last):
            """Rows to pair, members of dense hashes; the rows of the last hash wait for the next batch."""
            sig = rows[0]
            if not len(sig):
                state.update(rest=rows, full=full)
                return rows, (sig, sig)
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            counts = np.diff(np.concatenate((starts, [len(sig)])))
            many = counts > dense
            if full is not None and sig[0] == full:
                many[0] = True
            wait, heavy = len(sig) - int(counts[-1]), np.repeat(many, counts)
            light = ~heavy
            if last:
                state.update(rest=None, full=None)
            elif many[-1]:
                state.update(rest=[x[:0] for x in rows], full=int(sig[-1]))
            else:
                state.update(rest=[x[wait:] for x in rows], full=None)
                light[wait:] = False
            return [x[light] for x in rows], (rows[1][heavy], sig[heavy])

        def emit(light, heavy):
            a, b = pairs(*light)
            left, right = np.zeros(len(heavy[0]), np.int64), np.zeros(len(a), np.int64)
            first = np.concatenate((np.ones(len(a), bool), np.zeros(len(heavy[0]), bool)))
            columns = [pa.array(np.concatenate((a, heavy[0]))), pa.array(np.concatenate((b, left)), mask=~first), pa.array(np.concatenate((right, heavy[1])), mask=first)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sig"])

        for batch in batches:
            cols = [np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False))) for i, r in enumerate(rest)]
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)))
            yield emit(*cut([c[new] for c in cols], full, False))
            rest, full = state["rest"], state["full"]
        if state:
            yield emit(*cut(rest, full, True))

    ordered = signed.repartition("sig").sortWithinPartitions("sig", "h", "probe")
    return ordered.mapInArrow(run, "a long, b long, sig long")


def fetched(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, text): the lines at places (id, line, h), each h once. A place whose line has another hash gives no row."""
    wanted = places.groupBy("id").agg(F.collect_list(F.struct("line", "h")).alias("lines"))
    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "key")
    joined = source.join(wanted, F.col("key").eqNullSafe(F.col("id"))).select("text", "lines")

    def run(batches):
        for batch in batches:
            h, g, out = [], [], []
            for text, lines in zip(binaries(batch.column(0)), batch.column(1).to_pylist()):
                at = dict(split(text))
                for x in lines:
                    line = at.get(x["line"])
                    if line is not None:
                        a, b = _keys(line)
                        if a == x["h"]:
                            h.append(a)
                            g.append(b)
                            out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(out, pa.binary())], names=["h", "g", "text"])

    found = joined.mapInArrow(run, "h long, g long, text binary").groupBy("h").agg(F.min(F.struct("g", "text")).alias("x"))
    return found.select("h", "x.g", "x.text")


def verified(pairs: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose lines are within the edit distance."""
    left = lines.select(F.col("h").alias("a"), F.col("text").alias("x"))
    right = lines.select(F.col("h").alias("b"), F.col("text").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = [within(p.decode(errors="replace"), q.decode(errors="replace"), most) for p, q in zip(x, y)]
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def dense_links(members: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """(a, b): links that join all lines within `most` edits among those of one sig; members has sig and h."""
    sized = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_LINES)).cast("int").alias("blocks"))
    dealt = members.join(sized, "sig").join(lines.select("h", "text"), "h").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    met = dealt.withColumn("other", F.explode(other)).select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "h", "text")

    def compare(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        at = np.array(alike([t.decode(errors="replace") for t in table.column("text").to_pylist()], most), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(h[at[:, 0]], pa.int64()), "b": pa.array(h[at[:, 1]], pa.int64())})

    return met.groupBy("sig", "lo", "hi").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, most: int = 1, least: int = 16, dense: int = 64, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The line table, and (h, g, first_id, first_line) of each line whose class has other occurrences.

    first_id and first_line are the place of the class's occurrence that stays.
    """
    lines = written(line_table(docs, id_col, text_col))
    places = written(lines.groupBy("h", "g").agg(F.min(F.struct("id", "line")).alias("place"), F.count(F.lit(1)).alias("n")))
    found = written(candidates(signature_table(docs, most, least, text_col), most, dense).distinct())
    named = found.select(F.col("a").alias("h")).unionByName(found.where("b is not null").select(F.col("b").alias("h"))).distinct()
    needed = places.join(named, "h").select("place.id", "place.line", "h")
    content = written(fetched(docs, needed, id_col, text_col))
    crowded = written(found.where("b is null").select("sig", F.col("a").alias("h")))
    links = verified(found.where("b is not null").select("a", "b"), content, most).unionByName(dense_links(crowded, content, most))
    groups = components(links)
    known = content.select("h", "g").join(groups, F.col("h") == F.col("node")).select("h", "g", "component")
    joined = places.join(known, ["h", "g"], "left").select("h", "g", "place", "n", F.coalesce("component", "h").alias("component"), F.col("component").isNotNull().alias("linked"))
    shared = written(joined.where("n > 1 or linked"))
    first = shared.groupBy("component", "linked").agg(F.sum("n").alias("total"), F.min("place").alias("first")).where("total > 1")
    by_component = shared.where("linked").join(first.where("linked").select("component", "first"), "component").select("h", "g", "first")
    alone = shared.where("not linked").select("h", "g", F.col("place").alias("first"))  # equal lines only
    return lines, written(by_component.unionByName(alone).select("h", "g", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line")))


def removals(docs: DataFrame, most: int = 1, least: int = 16, dense: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gone): for each id that loses lines, the (line, h, g) of those that go."""
    lines, shared = classes(docs, most, least, dense, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))
    return lines.join(shared, ["h", "g"]).where(~stays).groupBy("id").agg(F.collect_list(F.struct("line", "h", "g")).alias("gone"))


def _without(text: bytes, gone: dict[int, set[tuple[int, int]]]) -> tuple[bytes, int, int]:
    """The text without the lines of those numbers and hashes, its number of lines before, and of lines that went."""
    lines = text.split(b"\n")
    n = sum(map(bool, map(bytes.strip, lines)))
    out = {i for i, keys in gone.items() if i < len(lines) and (bare := lines[i].strip()) and _keys(bare) in keys}
    return (b"\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text), n, len(out)


def deduplicated(docs: DataFrame, most: int = 1, least: int = 16, dense: int = 64, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with all its columns and rows, whatever their names, lines that repeat an earlier one gone from the text.

    With `counts` two columns more, _lines and _removed, count lines that aren't blank; columns of docs with these names
    give way to them. Null text stays null. Rows that repeat an id count as one document: their equal lines at equal numbers are one occurrence. A
    null id comes before all others, as one document. Lines under `least` characters go only if equal. Very long texts
    and lines are read whole. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("_lines", "_removed") if counts else docs
    gone = removals(docs, most, least, dense, id_col, text_col)
    source = docs.select(packed(docs, text_col).alias("row"), F.col(quoted(id_col)).alias("key"), F.col(quoted(text_col)).cast("binary").alias("text"))
    joined = source.join(gone, F.col("key").eqNullSafe(F.col("id")), "left").select("row", "text", "gone")
    schema = StructType([joined.schema["row"], joined.schema["text"]]).add("_lines", "long").add("_removed", "long")

    def run(batches):
        for batch in batches:
            out, n, removed = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys: dict[int, set[tuple[int, int]]] = {}
                for x in gone or ():
                    keys.setdefault(x["line"], set()).add((x["h"], x["g"]))
                kept, a, b = _without(text or b"", keys)
                out.append(None if text is None else kept)
                n.append(a)
                removed.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "_lines", "_removed"])

    cleaned = joined.mapInArrow(run, schema)
    return cleaned.select(*unpacked(docs, text_col), *(["_lines", "_removed"] if counts else []))
