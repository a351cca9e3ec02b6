"""Toxicity scores from non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained in numpy from confirmed toxic texts and from texts
without a label. With class prior p the risk is p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)):
the second part, the estimated risk on clean text, can't be negative; where a step makes it so, the step goes back
along its gradient instead (Kiryo et al., 2017). The prior is a parameter; where none is given, it is
the share of toxic rows among all labelled training rows, which is the only use of labels that say clean.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, binaries, mapped, quoted, texts, written

DIM = 1 << 18
CACHE = 200_000  # words whose buckets a task remembers; it starts anew beyond


class Features:
    """Buckets of a text: each distinct word and its beginnings of 4 to 7 bytes, by CRC-32."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        starts = [zlib.crc32(b"^" + word[:n]) % DIM for n in range(4, min(8, len(word) + 1))]
        return (zlib.crc32(word) % DIM, *starts)

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        out: list[int] = []
        for word in set(text.translate(LETTERS).split()):
            got = self.known.get(word)
            if got is None:
                got = self.known[word] = self.of_word(word)
            out += got
        return np.unique(np.array(out, np.int32))


@dataclass(frozen=True)
class Model:
    """weights: one float for each bucket, 1 MB in all."""

    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        z = float(self.weights[buckets].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _margin(w, b, rows, at):
    """Sums of weights over each row's buckets."""
    return np.add.reduceat(w[rows], at[:-1]) + b


def telling(a: np.ndarray, c: np.ndarray, positive: int, unlabelled: int, significance: float) -> np.ndarray:
    """Buckets that a of the toxic rows have more often than c of the unlabelled ones, by so many standard errors."""
    share = (a + c) / (positive + unlabelled)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / unlabelled))
    return (a / positive - c / unlabelled) / error > significance


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray], significance: float) -> np.ndarray:
    """The telling buckets of feature rows."""
    a, c = (np.bincount(np.concatenate(rows), minlength=DIM) for rows in (positive, unlabelled))
    return telling(a, c, len(positive), len(unlabelled), significance)


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4, significance: float = 5.0, batch: int = 2000, seed: int = 7
) -> Model:
    """Train by Adam on the non-negative risk with the logistic loss, over the buckets that select() leaves.

    At the end the bias moves so that a share `prior` of the unlabelled rows scores 0.5 or more. Equal rows at that
    border go together to the side that comes nearer to the share, and never to the toxic side if that were most rows:
    rows without a telling bucket are equal.
    No toxic or no unlabelled rows: a constant model, which calls everything clean in the first case.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(DIM, np.float32), -4.0 if not positive else 4.0)
    rng = np.random.default_rng(seed)
    telling = select(positive, unlabelled, significance)
    positive, unlabelled = ([x[telling[x]] for x in rows] for rows in (positive, unlabelled))
    w, m, v = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    b, mb, vb, step = -1.0, 0.0, 0.0, 0
    # a leading bucket that every row has keeps empty rows in place; its weight stays zero
    pos = [np.concatenate(([0], x)) for x in positive]
    unl = [np.concatenate(([0], x)) for x in unlabelled]
    rounds = max(1, -(-len(unl) // batch))
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
        for k in range(rounds):
            us = [unl[i] for i in order_u[k::rounds]]
            ps = [pos[i] for i in (order_p[k::rounds] if len(pos) >= rounds else order_p)]
            g, gb = np.zeros(DIM), 0.0
            zs = []
            for part in (ps, us):
                at = np.concatenate(([0], np.cumsum([len(x) for x in part])))
                rows = np.concatenate(part)
                zs.append((rows, at, _margin(w, b, rows, at)))
            (rp, ap, zp), (ru, au, zu) = zs
            sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            sp, su = sig(zp), sig(zu)
            soft = lambda z: np.logaddexp(0, z)  # noqa: E731  the logistic loss of -z
            if soft(zu).mean() - prior * soft(zp).mean() >= 0:
                cp, cu = np.full(len(zp), -prior / len(zp)), su / len(zu)
            else:
                cp, cu = prior * sp / len(zp), -su / len(zu)
            np.add.at(g, rp, np.repeat(cp, np.diff(ap)))
            np.add.at(g, ru, np.repeat(cu, np.diff(au)))
            gb = cp.sum() + cu.sum()
            g += decay * w
            g[0] = 0
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    at = np.concatenate(([0], np.cumsum([len(x) for x in unl])))
    z = np.sort(_margin(w, b, np.concatenate(unl), at))
    border = z[min(len(z) - 1, max(1, round(len(z) * (1 - prior)))) - 1]
    low, high = np.searchsorted(z, border, "left"), np.searchsorted(z, border, "right")  # rows equal to the last clean one
    with_them, wanted = len(z) - low, len(z) * prior
    if 2 * with_them <= len(z) and abs(with_them - wanted) <= abs(len(z) - high - wanted):
        high = low
    cut = z[0] - 1 if high == 0 else z[-1] + 1 if high == len(z) else (z[high - 1] + z[high]) / 2
    return Model(w.astype(np.float32), float(b - cut))


def _counted(batches):
    """(bucket, a, c): how many toxic and how many other rows of a task have each bucket."""
    counts = np.zeros((2, DIM), np.int64)
    for batch in batches:
        for p, f in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
            counts[0 if p else 1, np.frombuffer(f, np.int32)] += 1  # a row has a bucket once
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "a", "c"])


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_unlabelled: int, significance: float = 5.0) -> tuple[list, list, float]:
    """Feature rows of at most so many toxic labelled documents and of so many without a label; the labels' toxic share.

    The rows have telling buckets only: tasks count the buckets and drop the others, as whole rows of long texts would
    fill the driver. fit() gives the same model from them as from whole rows.

    labels has doc_id and toxic, one row per label; null labels and null ids are left out. Documents without a label are
    topped up with labelled ones, whatever their label, where they are fewer than asked for. Documents are drawn by a
    hash of doc_id, so that a rerun takes the same ones; of rows that repeat an id one is taken.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    if not total["n"]:
        return [], [], 0.0
    marks = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    drawn = marks.where("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_toxic).select("doc_id", F.lit(True).alias("p"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(marks.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    order = [F.coalesce("labelled", F.lit(False)), F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = drawn.unionByName(ids.orderBy(*order).limit(most_unlabelled).select("doc_id", F.lit(False).alias("p")))
    features = Features()

    def run(batch: pa.RecordBatch):
        rows = [features(t).tobytes() for t in binaries(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "p", "f"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    chosen = texts(docs, "doc_id").join(F.broadcast(drawn), "doc_id").select("doc_id", "p", "text")  # at most the two bounds
    once = written(mapped(chosen, run, f"doc_id {kind}, p boolean, f binary").groupBy("doc_id", "p").agg(F.min("f").alias("f")))
    number = {r["p"]: r["n"] for r in once.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = np.zeros(DIM, bool)
    if len(number) == 2:
        seen = once.select("p", "f").mapInArrow(_counted, "bucket int, a long, c long").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).toArrow()
        counts = np.zeros((2, DIM), np.int64)
        counts[:, seen.column("bucket").to_numpy()] = seen.column("a").to_numpy(), seen.column("c").to_numpy()
        keep = telling(*counts, number[True], number[False], significance)
    held = docs.sparkSession.sparkContext.broadcast(keep)

    def cut(batch: pa.RecordBatch):
        rows = [np.frombuffer(f, np.int32) for f in binaries(batch.column(2))]
        rows = pa.array([x[held.value[x]].tobytes() for x in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "p", "f"])

    rows = mapped(once, cut, f"doc_id {kind}, p boolean, f binary").toArrow()  # as Arrow, as rows of Python objects would take several times the memory
    keys, side, found = rows.column("doc_id").to_pylist(), rows.column("p").to_pylist(), rows.column("f")
    sides = {True: [], False: []}
    for i in sorted(range(len(keys)), key=lambda i: keys[i]):
        sides[side[i]].append(np.frombuffer(found[i].as_buffer(), np.int32))
    return sides[True], sides[False], (total["toxic"] or 0) / total["n"]


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_unlabelled: int = 9000, prior: float | None = None, significance: float = 5.0, **options) -> Model:
    """A model from the documents that labels names as toxic and from documents without a label.

    prior is the share of toxic documents among those without a label; None takes it from the labels. The sample's two
    bounds are the only ones.
    """
    positive, unlabelled, share = training_rows(docs, labels, most_toxic, most_unlabelled, significance)
    return fit(positive, unlabelled, share if prior is None else prior, significance=significance, **options)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): one row per row of docs, score in 0 to 1; a null or empty text has the model's bias alone.

    Repeated rows each get a row. Very long texts are read whole. Other columns are not read. An empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    features = Features()

    def run(batch: pa.RecordBatch):
        scores = [held.value.score(features(t)) for t in binaries(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    return mapped(source, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all columns, whatever their names.

    Rows without text stay, those with an empty one are scored. Rows that repeat stay or go together. Very long texts
    are scored whole. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    features = Features()

    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd

        return pd.Series([t is None or held.value.score(features(bytes(t))) < threshold for t in text], dtype="boolean")

    return docs.where(clean(F.col(quoted(text_col)).cast("binary")))
