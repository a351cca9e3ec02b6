"""SimHash near-duplicates, found with an inverted index over byte positions and a count filter (velar.llm.postings).

Fingerprints of whole texts stand for similarity only near to identity: sets of shingles with a Jaccard similarity of
0.8 have fingerprints some ten bits apart, where no byte is guaranteed to agree. kept(similarity=...) therefore puts
seeded fingerprints of min-wise samples into the same index, and whole sets decide at the end (velar.llm.jaccard).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import LOWER, binaries, mapped, quoted, texts, written
from .graph import components
from .postings import BITS, links

BLOCK = 1 << 16


def simhash(text: bytes, ngram: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: XXH64 of each shingle of lower-cased words; a bit is set if over half have it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - ngram + 1)
    starts, ends = starts[:n].tolist(), ends[min(ngram, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        part = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])])
        counts += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, ngram: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs, fp being the fingerprint's 64 bits as a signed long; null text: zero."""
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batch: pa.RecordBatch):
        bits = np.array([simhash(t, ngram) for t in binaries(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return mapped(source, run, f"id {kind}, fp long")


def near_duplicates(
    docs: DataFrame, ngram: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", dense: int = 64
) -> DataFrame:
    """(id_col, fp, component_id): each row of docs with its fingerprint and the smallest id reachable over links.

    Texts without words have fingerprint zero and link like others. Rows with the same id each keep their row; a null
    id keeps its row, and its group's id comes from the others (null if there are none). Ties need no rule: groups
    are connected components. Other columns of docs are not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, ngram, id_col, text_col))
    groups = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(groups.select("fp"), distance, dense))
    roots = groups.join(found, groups.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    roots = written(roots)
    best = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    class_of = roots.join(best, "component").select("fp", "component_id")
    return prints.join(class_of, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def kept(docs: DataFrame, similarity: float | None = None, **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its near-duplicate group, with all columns.

    Groups come from near_duplicates(), or with a similarity from pairs of shingle sets with that Jaccard similarity or
    more. Rows that repeat an id are kept or go together; null ids stay, as nothing can name them. Texts without words
    are alike. Very long texts are read whole. An empty table gives an empty result.
    """
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options) if similarity is None else jaccard.near_duplicates(docs, similarity=similarity, **options)
    name = f"_gone_{uuid.uuid4().hex}"  # no column of docs
    gone = found.where(F.col(quoted(id_col)) != F.col("component_id")).select(F.col(quoted(id_col)).alias(name)).distinct()
    return docs.join(gone, F.col(quoted(id_col)) == F.col(name), "left_anti")
