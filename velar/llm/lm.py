"""Documents scored by cross-entropy difference (Moore and Lewis, 2010).

Two models of the same form, smoothing and vocabulary: one of target documents, one of all documents. A token is a word
of the text after A-Z became a-z. A word's chance leans with `weight` pseudo-counts on the chance of its spelling, a
model of byte trigrams over the word, the space behind it and the two bytes before it, so that every word has one:

    p(w) = (c(w) + weight spelling(w)) / (N + weight)
    spelling(w) = product over bytes of (c3 + weight p2) / (c2 + weight), where p2 leans on p1, and p1 on 1 / 256

A document's score is the mean over its words of the background's loss minus the target's: above zero it looks more
like the target. A document's own words are taken out of the word counts before it is scored, so that being part of a
model, as targets are, says nothing about it; its bytes are not, as they are few among all.

Nothing of a model is sent whole to any task: documents are dealt into chunks of about `chunk_bytes`. A chunk sends each
of its different words and byte sequences once, with counts; the sums of those that other chunks have as well go back
to the chunks that sent them, and a chunk knows the rest by itself. The tables of words grow with the corpus. A word is
known by 63 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, small_batches, texts

LOWERED = bytes(32 if 9 <= b <= 13 else b for b in LOWER)
WORD = np.uint64(1 << 63)
#: Tags of keys of byte sequences: three bytes, two before any third, two, one before any second, one; and the totals.
THREE, BEFORE_THREE, TWO, BEFORE_TWO, ONE, BYTES, WORDS = (k << 32 for k in range(1, 8))
KNOWN = 1 << 18  # words whose hashes a task remembers; it starts anew beyond


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1 << 63
        return h


class Chunk:
    """Words and bytes of a chunk's documents in one row, and how often each occurs, also in target documents.

    The table has a row for each document, and one with mark and without text for each target id.
    """

    def __init__(self, table: pa.Table) -> None:
        ids, mark = table.column("id").to_pylist(), table.column("mark").to_pylist()
        targets = {k for k, m in zip(ids, mark) if m}
        self.rows = np.array([i for i, m in enumerate(mark) if not m], np.int64)
        self.target = np.array([ids[i] in targets for i in self.rows.tolist()], bool)
        hashes, words, buffer, sizes = Hashes(), [], [], []
        column = table.column("text")
        for i in self.rows.tolist():
            low = (column[i].as_py() or b"").translate(LOWERED)
            split = low.split()
            words.append(np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)))
            sizes.append(len(split))
            buffer.append(b"  " + low + b" ")
        self.sizes = np.array(sizes, np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)
        data = np.frombuffer(b"".join(buffer), np.uint8)
        self.words, self.at = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        used = np.flatnonzero(np.bincount(data, minlength=256))
        self.used, a = used, len(used)
        small = np.zeros(256, np.int32)
        small[used] = np.arange(a, dtype=np.int32)
        letter = data != 32
        told = np.flatnonzero(letter[2:] | letter[1:-1]).astype(np.int32) + 2  # bytes of words, and the space behind each
        code = small[data]
        self.code = (code[told - 2] * a + code[told - 1]) * a + code[told]
        ends = np.flatnonzero(~letter[told])
        self.starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        in_target = self.target[self.owner]
        parts = [np.bincount(self.at, minlength=len(self.words)), np.bincount(self.at[in_target], minlength=len(self.words))]
        per_byte = np.repeat(in_target, np.diff(np.append(self.starts, len(told)))) if len(self.starts) else np.zeros(0, bool)
        cubes = [np.bincount(c, minlength=a**3).reshape(a, a, a) for c in (self.code, self.code[per_byte])]
        self.grams, counts = self._grams(cubes)
        self.keys = np.concatenate((self.grams, self.words))  # byte keys are smaller, so all are sorted
        self.counts = [np.concatenate((g, w)) for g, w in zip(counts, parts)]

    def _grams(self, cubes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys and counts of all byte sequences that occur, and of the two totals."""
        u, keys, counts = self.used.astype(np.int64), [], ([], [])
        pair = u[:, None] << 8 | u
        for tag, key, axes in (
            (THREE, u[:, None, None] << 16 | pair[None], ()), (BEFORE_THREE, pair, (2,)), (TWO, pair, (0,)), (BEFORE_TWO, u, (0, 2)), (ONE, u, (0, 1)), (BYTES, np.zeros(1, np.int64), (0, 1, 2)),
        ):
            sums = [np.atleast_1d(c.sum(axes)).ravel() if axes else c.ravel() for c in cubes]
            some = np.flatnonzero(sums[0])
            keys.append(tag | key.ravel()[some])
            for k in range(2):
                counts[k].append(sums[k][some])
        keys.append(np.array([WORDS]))
        for k, n in enumerate((len(self.owner), int(self.target[self.owner].sum()))):
            counts[k].append(np.array([n]))
        return np.concatenate(keys).astype(np.uint64), [np.concatenate(c) for c in counts]

    def learn(self, keys: np.ndarray, n: np.ndarray, n_target: np.ndarray) -> None:
        """Take the sums over all chunks for those keys."""
        at = np.searchsorted(self.keys, keys)
        self.counts[0][at], self.counts[1][at] = n, n_target

    def _spelling(self, counts: np.ndarray, weight: float) -> np.ndarray:
        """Logarithm of the chance of each word's spelling."""
        a, keys = len(self.used), self.grams.astype(np.int64)
        place = np.zeros(256, np.int64)
        place[self.used] = np.arange(a)

        def table(tag: int, size: int) -> np.ndarray:
            mine = keys >> 32 == tag >> 32
            key, out = keys[mine] & (1 << 32) - 1, np.zeros(a**size)
            code = np.zeros(len(key), np.int64)
            for k in range(size):
                code = code * a + place[key >> 8 * (size - 1 - k) & 255]
            out[code] = counts[: len(keys)][mine]
            return out.reshape((a,) * size)

        one = (table(ONE, 1) + weight / 256) / (float(counts[: len(keys)][keys == BYTES].sum()) + weight)
        two = (table(TWO, 2) + weight * one) / (table(BEFORE_TWO, 1)[:, None] + weight)
        three = (table(THREE, 3) + weight * two) / (table(BEFORE_THREE, 2)[:, :, None] + weight)
        return np.add.reduceat(np.log(three).ravel()[self.code], self.starts) if len(self.starts) else np.zeros(0)

    def losses(self, weight: float) -> list[np.ndarray]:
        """Sum of each document's losses under the target and under the background."""
        code = self.owner * (len(self.words) + 1) + self.at
        _, at, n = np.unique(code, return_inverse=True, return_counts=True)
        own, out = n[at], []
        size, mine = self.sizes[self.owner], self.target[self.owner]
        for counts, part in ((self.counts[1], mine), (self.counts[0], np.ones(len(mine), bool))):
            total = float(counts[: len(self.grams)][self.grams == WORDS].sum())
            left = counts[len(self.grams) :][self.at] - own * part
            p = (left + weight * np.exp(self._spelling(counts, weight))) / (total - size * part + weight)
            out.append(np.bincount(self.owner, -np.log(p), minlength=len(self.sizes)))
        return out


def scored(
    docs: DataFrame, target_ids: DataFrame, weight: float = 4.0, chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_tokens, ce_target, ce_background, score): one row per row of docs, losses in nats a word.

    target_ids names the target documents in its column id_col; ids that repeat, are null or name no document add
    nothing. Null and empty texts have no tokens and null losses. Rows that repeat count each; those of one id share a
    chunk, which a task holds whole, and so is any single text, however long. Without any target the target model is
    that of equally likely bytes. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    plain = texts(docs, id_col, text_col=text_col).withColumnRenamed(id_col, "id").withColumn("mark", F.lit(False))
    marks = target_ids.select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct()
    marks = marks.select("id", F.lit(None).cast("binary").alias("text"), F.lit(True).alias("mark"))
    total = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = F.lit(max(1, -(-total // chunk_bytes)))
    place = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    dealt = plain.unionByName(marks).withColumn("chunk", F.pmod(place, chunks).cast("int"))

    def ask(whole: pa.Table) -> pa.Table:
        chunk = Chunk(whole)
        number = np.full(len(chunk.keys), whole.column("chunk")[0].as_py(), np.int32)
        return pa.table({"chunk": pa.array(number), "gram": pa.array(chunk.keys.view(np.int64)), "n": pa.array(chunk.counts[0]), "n_target": pa.array(chunk.counts[1])})

    def score(whole: pa.Table, answers: pa.Table) -> pa.Table:
        if not whole.num_rows:
            return pa.table({"id": whole.column("id"), "n_tokens": pa.array([], pa.int64()), "ce_target": pa.array([], pa.float64()), "ce_background": pa.array([], pa.float64())})
        chunk = Chunk(whole)
        chunk.learn(answers.column("gram").to_numpy().view(np.uint64), answers.column("n").to_numpy(), answers.column("n_target").to_numpy())
        size = np.maximum(chunk.sizes, 1)
        losses = [pa.array(x / size, mask=chunk.sizes == 0) for x in chunk.losses(weight)]
        return pa.table({"id": whole.column("id").take(pa.array(chunk.rows)), "n_tokens": pa.array(chunk.sizes), "ce_target": losses[0], "ce_background": losses[1]})

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, gram long, n long, n_target long")
    same = Window.partitionBy("gram")
    summed = asked.select("chunk", "gram", F.sum("n").over(same).alias("n"), F.sum("n_target").over(same).alias("n_target"), F.count(F.lit(1)).over(same).alias("senders"))
    answers = summed.where("senders > 1").drop("senders")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"id {kind}, n_tokens long, ce_target double, ce_background double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ce_target", "ce_background", (F.col("ce_background") - F.col("ce_target")).alias("score"))
