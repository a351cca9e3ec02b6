"""Language identification: multinomial naive Bayes over hashed character n-grams.

n-grams of one to three letters, with word borders, fall into DIM buckets. Training sums bucket counts per language
over all labelled rows; the log-probability matrix goes to every task, which scores a batch of texts from their sparse
bucket counts. Of more than LANGUAGES languages blocks of that many go to the tasks one after another, in order of
name, and what was best so far goes with the texts; the driver and a task hold one block's matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binaries, quoted, texts, written

DIM = 1 << 14
LANGUAGES = 500  # languages of which the numbers are held at a time
BLOCK = 1 << 20  # characters looked at together, and what is left of the last word
_BMP = np.array([chr(c).isalpha() for c in range(1 << 16)])


def buckets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets and their counts; none if it has no letter."""
    whole = text.decode(errors="replace").lower()
    total = np.zeros(DIM, np.int64)
    letters, last = False, 0
    at = 0
    while at < len(whole):
        begin, at = at, at + BLOCK
        while at < len(whole) and whole[at - 1].isalpha() and whole[at].isalpha():
            at += 1
        c = np.frombuffer((" " + whole[begin:at] + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        alpha = np.where(c < 1 << 16, _BMP[np.minimum(c, (1 << 16) - 1)], False)
        for x in np.unique(c[c >= 1 << 16]).tolist():
            alpha[c == x] = chr(x).isalpha()
        if not alpha.any():
            continue
        letters = True
        c = np.where(alpha, c, 32)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one space between words
        two = c[:-1] * 1000003 + c[1:]
        three = two[:-1] * 1000003 + c[2:]
        if last:  # over the space between this part and the one before
            three = np.append(three, (last * 1000003 + 32) * 1000003 + c[1])
        last = int(c[-2])
        one = c[c != 32] + (1 << 40)
        grams = np.concatenate((one, two + (1 << 41), three)).astype(np.uint64)
        total += np.bincount((grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64), minlength=DIM)
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Block:
    """Languages by name, the logarithms of their shares of documents, and of their buckets' (languages x DIM)."""

    names: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of texts with letters, and each language's log-likelihood of each of them.

        The texts' buckets and counts stand in one row each, a sparse matrix by rows; each language's scores are sums
        over stretches of it.
        """
        found = [buckets(t) for t in texts]
        sizes = np.array([len(at) for at, _ in found], np.int64)
        rows = np.flatnonzero(sizes)
        if not len(rows) or not self.names:
            return rows, np.empty((0, len(rows)))
        at, n = (np.concatenate([found[k][i] for k in rows]) for i in range(2))
        starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
        return rows, np.stack([p + np.add.reduceat(log[at].astype(np.float64) * n, starts) for p, log in zip(self.prior, self.log_prob)])


@dataclass(frozen=True)
class Model:
    """Bucket counts by language, as written rows (lang, bucket, n), and each language's number of documents."""

    rows: DataFrame
    docs: dict[str, int]
    smoothing: float

    def blocks(self, size: int = LANGUAGES) -> Iterator[Block]:
        """Blocks of languages in order of name, one at a time; without any language one empty block."""
        names, total = sorted(self.docs), sum(self.docs.values())
        for k in range(0, max(1, len(names)), size):
            part = names[k : k + size]
            counts, place = np.zeros((len(part), DIM)), {x: i for i, x in enumerate(part)}
            if part:
                some = self.rows.where((F.col("lang") >= part[0]) & (F.col("lang") <= part[-1]) & (F.col("bucket") < DIM)).toArrow()
                at = np.array([place[x] for x in some.column("lang").to_pylist()], np.int64)
                counts[at, some.column("bucket").to_numpy()] = some.column("n").to_numpy()
            likely = counts + self.smoothing
            prior = np.log(np.array([self.docs[x] for x in part]) / total) if part else np.zeros(0)
            yield Block(tuple(part), prior, np.log(likely / likely.sum(1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> Model:
    """A model of all rows with a language that isn't null and a text with letters. No such rows: a model of nothing.

    Any number of languages; a task adds up LANGUAGES of them before it hands their sums on.
    """
    known = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("binary").alias("text")).where("lang is not null and text is not null")

    def told(sums):
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                at, n = buckets(text)
                if len(at):
                    if len(sums) >= LANGUAGES and lang not in sums:
                        yield from told(sums)
                        sums = {}
                    have = sums.setdefault(lang, np.zeros(DIM + 1, np.int64))
                    have[at] += n
                    have[DIM] += 1  # documents
        yield from told(sums)

    rows = written(known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = rows.where(F.col("bucket") == DIM).select("lang", "n").toArrow()  # a name and a number for each language
    return Model(rows, dict(zip(found.column("lang").to_pylist(), found.column("n").to_pylist())), smoothing)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = LANGUAGES) -> DataFrame:
    """(id_col, lang_pred, score): one row per row of docs, repeated ones as well.

    A null text, one without letters, or a model of nothing gives `und` and 0. Of equal scores the first language by
    name stands. Very long texts are read whole, in parts. Other columns are not read. An empty table gives an empty
    result.
    """
    source = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id")
    none = {"lang_pred": F.lit("und"), "best": F.lit(None).cast("double"), "total": F.lit(0.0)}
    out, last = source.select("id", "text", *[c.alias(n) for n, c in none.items()]), max(0, (len(model.docs) - 1) // block)
    schema = StructType([out.schema["id"]]).add("lang_pred", "string").add("best", "double").add("total", "double")
    for k, part in enumerate(model.blocks(block)):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, held=held, more=k < last):
            for batch in batches:
                names, best, total = (batch.column(i).to_pylist() for i in (2, 3, 4))
                rows, z = held.value.scores(binaries(batch.column(1)))
                for i, row in enumerate(rows.tolist() if len(z) else ()):
                    here = z[:, i]
                    at = int(here.argmax())
                    top = here[at] if best[row] is None else max(best[row], here[at])
                    old = total[row] * np.exp(best[row] - top) if best[row] is not None else 0.0
                    if best[row] is None or here[at] > best[row]:
                        names[row] = held.value.names[at]
                    best[row], total[row] = float(top), float(old + np.exp(here - top).sum())
                columns = [pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([batch.column(1)] if more else [])], names=["id", "lang_pred", "best", "total", *(["text"] if more else [])])

        kind = StructType([*schema, *([out.schema["text"]] if k < last else [])])
        out = out.select("id", "text", "lang_pred", "best", "total").mapInArrow(run, kind)
        if k < last:
            out = written(out)
            held.destroy()
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.lit(1.0) / F.col("total"))
    return out.select(F.col("id").alias(id_col), "lang_pred", score.alias("score"))
