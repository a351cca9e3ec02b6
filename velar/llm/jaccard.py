"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints find candidates, whole sets decide.

Texts of equal shingle sets are one node. A set has one fingerprint of all its shingles and `BANDS` seeded ones, each
of a min-wise sample of `ROWS` of them. All go into one inverted index over byte positions, whose count filter and
Hamming check say which are close (velar.llm.postings). Sets near to identity are close by the first one; two sets of
similarity s draw the same sample, and so have an equal fingerprint, with probability s^3 for each seed: none of 18
does at 0.8 for 3 pairs in a million. Equal fingerprints are one entry of the index, and sets that share one are linked
to the least of them, so that edges are linear in the sets however many share it; the components of these edges hold
every pair to look at. A component's sets meet once, in one task, where every pair of different true
components is compared whole. A component of more than `room` bytes is dealt into blocks, and each two blocks meet in
a task: what a task holds stays bounded, and no pair is left out. Time is quadratic only in a large component whose
sets are mostly not alike; sets already joined are not compared with each other.

A shingle is known by 64 bits; among n different shingles n^2 / 2^65 equal hashes are to be expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import LOWER, binaries, mapped, texts, written
from .graph import components

BANDS, ROWS, BLOCK = 18, 3, 1 << 12
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, (3, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingles(text: bytes, ngram: int) -> np.ndarray:
    """Sorted different hashes of the runs of ngram lower-cased words; all words are one run where there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(ngram, len(words))
    n, out = len(words) - size + 1, np.uint64(size)
    for i in range(size):
        out = out + _mixed(hashes[i : i + n] + _PLACES[i]) * _PLACES[i + 1]
    return np.unique(_mixed(out))


def fingerprint(grams: np.ndarray) -> int:
    """The set's own fingerprint, signed: a bit is set if over half of the shingles' hashes have it; zero if it is empty."""
    counts = np.zeros(postings.BITS, np.int64)
    for i in range(0, len(grams), BLOCK):
        counts += np.unpackbits(grams[i : i + BLOCK].view(np.uint8)).reshape(-1, postings.BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams)).view(np.int64)[0])


def bands(grams: np.ndarray) -> np.ndarray:
    """The seeded fingerprints of a set: each is the bits that over half of its ROWS min-wise drawn shingles have."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(grams), BLOCK):
        least = np.minimum(least, ((grams[i : i + BLOCK, None] ^ _SEEDS[0]) * _SEEDS[1]).min(0))
    a, b, c = _mixed(least + _SEEDS[2]).reshape(BANDS, ROWS).T  # a seed for each place keeps the samples apart
    return (a & b | a & c | b & c).view(np.int64)


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def set_table(docs: DataFrame, ngram: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, size, prints): one row per row of docs; prints are its fingerprints; null text is an empty set."""
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batch: pa.RecordBatch):
        sets = [shingles(t, ngram) for t in binaries(batch.column(1))]
        prints = np.array([[fingerprint(s), *bands(s)] for s in sets], np.int64).reshape(-1)
        places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (1 + BANDS))
        columns = [batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(places, pa.array(prints))], names=["id", "key", "size", "prints"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return mapped(source, run, f"id {kind}, key long, size long, prints array<long>")


def joined(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of places whose sets are alike, enough of them to join all that pairs of alike sets join."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    codes_of = lambda i: codes[ends[i] - sizes[i] : ends[i]]
    here = np.zeros(len(every) + 1, bool)
    left = np.argsort(sizes, kind="stable")
    left = left[sizes[left] > 0]  # empty sets are equal, so there is one node of them
    out, queue = [], []
    flat = starts = None
    while len(left) or queue:
        if not queue:
            queue, left, flat = [int(left[0])], left[1:], None
        i = queue.pop()
        if not len(left):
            continue
        if flat is None:
            flat = np.concatenate([codes_of(j) for j in left])
            starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
        here[codes_of(i)] = True
        common = np.add.reduceat(here[flat], starts, dtype=np.int64)
        here[codes_of(i)] = False
        alike = common >= similarity * (sizes[left] + sizes[i] - common) - 1e-9
        if alike.any():
            found = left[alike].tolist()
            out += [(i, j) for j in found]
            queue += found
            left, flat = left[~alike], None
    return out


def links(docs: DataFrame, nodes: DataFrame, ngram: int, similarity: float, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links between the keys of nodes (key, least, size, prints) that join all sets of that similarity.

    Candidates are the sets of which two fingerprints are at most two bits apart.
    """
    posts = nodes.select("key", F.explode("prints").alias("fp"))
    hubs = written(posts.groupBy("fp").agg(F.min("key").alias("a"), F.max("key").alias("z")))
    equal = posts.join(hubs.where("a < z").select("fp", "a"), "fp").where("a < key").select("a", F.col("key").alias("b"))
    close = postings.links(hubs.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    close = close.join(hubs.select(F.col("fp").alias("x"), "a"), "x").join(hubs.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    edges = equal.unionByName(close.where("a != b").select("a", "b"))
    near = components(edges.distinct())
    members = written(nodes.join(near, nodes.key == near.node).select("key", "least", "size", "component"))
    blocks = members.groupBy("component").agg(F.ceil(F.sum(8 * F.col("size")) / F.lit(room)).cast("int").alias("blocks"))
    wanted = members.join(blocks, "component").select("key", "least", "component", "blocks")
    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    found = source.join(wanted, F.col("id").eqNullSafe(F.col("least"))).select("key", "component", "blocks", "text")

    def run(batch: pa.RecordBatch):
        grams = [shingles(t, ngram) for t in binaries(batch.column(3))]
        good = [set_key(s) == k for s, k in zip(grams, batch.column(0).to_pylist())]  # rows may repeat an id
        whole = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in grams], pa.binary())], names=["key", "component", "blocks", "grams"])
        yield whole.filter(pa.array(good, pa.bool_()))

    sets = mapped(found, run, "key long, component long, blocks int, grams binary")
    own = F.pmod("key", "blocks").cast("int")
    other = F.when(F.col("blocks") <= 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), own))
    dealt = sets.withColumn("own", F.when(F.col("blocks") <= 1, 0).otherwise(own)).withColumn("other", F.explode(other))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "grams")

    def compare(table: pa.Table) -> pa.Table:
        keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
        grams = table.column("grams").take(pa.array(first))
        pairs = joined([np.frombuffer(x.as_buffer(), np.uint64) for x in grams], similarity)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(keys[at[:, 0]], pa.int64()), "b": pa.array(keys[at[:, 1]], pa.int64())})

    return dealt.groupBy("component", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", room: int = 4 << 20) -> DataFrame:
    """(id_col, component_id): each row of docs with the smallest id reachable over pairs of that similarity or more.

    Texts without words are alike. Rows with the same id each keep their row; a null id keeps its row, and its group's
    id comes from the others (null if there are none). Other columns of docs are not read. An empty table gives an empty
    result.
    """
    prints = written(set_table(docs, ngram, id_col, text_col))
    nodes = written(prints.groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("prints").alias("prints")))
    found = components(links(docs, nodes, ngram, similarity, room, id_col, text_col))
    roots = written(nodes.join(found, nodes.key == found.node, "left").select("key", "least", F.coalesce("component", "key").alias("component")))
    best = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    class_of = roots.join(best, "component").select("key", "component_id")
    return prints.select("id", "key").join(class_of, "key", "left").select(F.col("id").alias(id_col), "component_id")

