"""Packing of token sequences into batches, over length buckets that waste the least padding.

Documents are tokenised and cut into pieces of at most `context` tokens. The global histogram of piece lengths has at
most `context` entries; dynamic programming over it chooses the `buckets` upper bounds with the smallest padding in
all. Inside a bucket every batch holds as many pieces, padded to the bucket's bound, as fit `token_budget`.

A bucket may hold most of all pieces, so places in it are not counted in one task: pieces are dealt into slices by a
hash of where they were read, written with them, so that rows with equal or null ids spread as well. Slices are counted,
and pieces are numbered within their slice from the sum of the slices before it.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, texts, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary expects text to be cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LARGEST_VOCABULARY = 64 << 20  # bytes of a tokenizer file, which goes to all tasks
SLICE_ROWS = 100_000


def bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, at most `buckets` of them and the last the largest length, with the least padding in all.

    best[j] is the least padding of the lengths up to the j-th with k buckets; bucket (i, j] pads each of its pieces
    to the j-th length. Of equal choices the one with the earlier cut stands. Lengths of zero take no part.
    """
    lengths = np.array(sorted(x for x in histogram if x > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    n = np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(counts * lengths)))
    size = len(lengths)
    best = np.concatenate(([0], lengths * n[1:] - total[1:])).astype(np.float64)
    cuts = []
    for _ in range(1, min(buckets, size)):
        now, cut = best.copy(), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + (lengths[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j]))
            i = int(np.argmin(cost))
            now[j], cut[j] = cost[i], i
        best = now
        cuts.append(cut)
    out, j = [], size
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            return out[::-1]
    out.append(int(lengths[j - 1]))
    return out[::-1]


def _ranks(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} is larger than {LARGEST_VOCABULARY} bytes")
    return data


def pieces(docs: DataFrame, context: int, tokenizer: str = TOKENIZER, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, n_tokens, at): each document's tokens in runs of at most context; without tokens one empty piece.

    at is a hash of the row's place in its task, another one for every piece. The vocabulary file is read by the driver
    and sent to the tasks, which need no file of their own.
    """
    held = docs.sparkSession.sparkContext.broadcast((_ranks(tokenizer), pattern))
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batches):
        import tiktoken

        data, pattern = held.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        before = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = np.array([_count(encode, t.decode(errors="replace")) for t in binaries(batch.column(1))], np.int64)
            each = np.maximum(1, -(-sizes // context))
            owner = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * context
            n = np.minimum(context, sizes[owner] - start)
            at = (np.arange(before, before + len(owner), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            at, before = (at ^ at >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9), before + len(owner)
            columns = [batch.column(0).take(pa.array(owner)), pa.array(piece), pa.array(start), pa.array(n), pa.array(at.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "n_tokens", "at"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return source.mapInArrow(run, f"id {kind}, piece long, start long, n_tokens long, at long")


def _count(encode, text: str, size: int = 1 << 20) -> int:
    """Number of tokens, from parts of about size characters that end before a space where the pattern cuts anyway."""
    n, at = 0, 0
    while at < len(text):
        end = at + size
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and text[end + 1 : end + 2].isalnum()):
            end += 1
        n += len(encode(text[at:end]))
        at = end
    return n


def packed(
    docs: DataFrame, context: int = 2048, buckets: int = 8, token_budget: int = 65536, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, piece, start, n_tokens, bucket, batch, slot): where each piece goes.

    bucket is its upper bound, batch counts from 0 within the bucket, slot from 0 within the batch. Null and empty
    texts keep one row with no tokens and null places. Every row of docs counts, repeated ones and null ids as well.
    Very long texts are tokenised whole, in parts. Other columns aren't read. Rows read in the same order and tasks give
    the same batches. An empty table gives an empty result.
    """
    if token_budget < context:
        raise ValueError("token_budget must hold a piece of context tokens")
    cut = written(pieces(docs, context, tokenizer, id_col=id_col, text_col=text_col))
    histogram = {r["n_tokens"]: r["n"] for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    uppers = bounds(histogram, buckets)
    slices = max(1, -(-sum(histogram.values()) // SLICE_ROWS))
    fitting = F.array_min(F.filter(F.array(*[F.lit(x) for x in uppers]).cast("array<long>"), lambda x: x >= F.col("n_tokens")))
    placed = cut.withColumn("bucket", F.when(F.col("n_tokens") > 0, fitting))
    placed = placed.withColumn("_slice", F.pmod("at", F.lit(slices)))
    sizes = placed.where("bucket is not null").groupBy("bucket", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_slice")) - F.col("_n")
    offsets = sizes.select("bucket", "_slice", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("at")) - 1
    full = placed.where("bucket is not null").withColumn("_number", number).join(offsets, ["bucket", "_slice"])
    rank, capacity = F.col("_number") + F.col("_before"), F.floor(F.lit(token_budget) / F.col("bucket"))
    columns = [F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket"]
    done = full.select(*columns, F.floor(rank / capacity).cast("long").alias("batch"), (rank % capacity).cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    return done.unionByName(placed.where("bucket is null").select(*columns, none.alias("batch"), none.alias("slot")))
