"""Replies of a slow provider, such as a language model, within a budget of time for each document.

A document's blocks are asked in order, one after another, in one task; when its time is up the rest of its blocks go
unasked. So a document takes its budget at most, however many blocks it has, and none fails a job: a block without a
reply says why. Replies are written once before they are read, as asking again would give other ones.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from velar.sources.tables import written

BUDGET, LONGEST_CALL = 300.0, 300.0  # seconds for a document and for one call


def called(provider: Callable[[str], str | None], text: str, seconds: float) -> tuple[str | None, str | None]:
    """(reply, None), or (None, reason) if there is none within so many seconds. A call that hangs is left behind."""
    answers: queue.Queue = queue.Queue()

    def ask() -> None:
        try:
            answers.put((provider(text), None))
        except Exception as e:
            answers.put((None, f"failed: {type(e).__name__}"))

    threading.Thread(target=ask, daemon=True).start()
    try:
        reply, reason = answers.get(timeout=max(0.0, seconds))
    except queue.Empty:
        return None, "budget"
    return (None, reason or "empty") if reply is None or not str(reply).strip() else (str(reply), None)


class Asking:
    """Asks for blocks that come by document; a document's time starts with its first block."""

    def __init__(self, provider: Callable[[str], str | None], seconds: float, longest: float):
        self.provider, self.seconds, self.longest = provider, seconds, longest
        self.doc, self.ends = object(), 0.0

    def replies(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(document, block, reply, reason) of (document, block, text)."""
        for doc, block, text in rows:
            if doc != self.doc:
                self.doc, self.ends = doc, time.monotonic() + self.seconds
            left = self.ends - time.monotonic()
            if text is None or not text.strip():
                yield doc, block, None, "empty"
            elif left <= 0:
                yield doc, block, None, "budget"
            else:
                yield doc, block, *called(self.provider, text, min(left, self.longest))


def replies(
    blocks: DataFrame, provider: Callable[[str], str | None], doc: str, block: str, text_col: str = "text", seconds: float = BUDGET, longest: float = LONGEST_CALL, most: int | None = None
) -> DataFrame:
    """(doc, block, reply, reason): one row for each block; reason is null where there is a reply.

    Reasons are "budget" (the document's time, or one call's, was up), "failed: <kind>", and "empty" for a text or reply
    without anything. provider is called in the tasks and must be one that they can load. With `most` only a document's
    first blocks are asked, the others have "budget". Documents are dealt by id and a document stays in one task, which
    its budget bounds; null ids are one document. Blocks that repeat are asked each. An empty table gives an empty result.
    """
    rows = blocks.select(F.col(doc).alias("doc"), F.col(block).alias("block"), F.col(text_col).alias("text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("block"))
    rows = rows.withColumn("text", F.when(number <= most, F.col("text"))).withColumn("over", F.col("text").isNull() & (number > most)) if most is not None else rows.withColumn("over", F.lit(False))
    schema = StructType([rows.schema["doc"], rows.schema["block"]]).add("reply", "string").add("reason", "string")

    def run(batches):
        over: dict[str, bool] = {}

        def each(batch):
            for d, b, t, unasked in zip(*(c.to_pylist() for c in batch.columns)):
                over["now"] = unasked
                yield d, b, t

        state = Asking(provider, seconds, longest)
        for batch in batches:
            found = [(reply, "budget" if over["now"] else reason) for _, _, reply, reason in state.replies(each(batch))]
            reply, reason = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reply, pa.string()), pa.array(reason, pa.string())], names=["doc", "block", "reply", "reason"])

    dealt = rows.repartition("doc").sortWithinPartitions("doc", "block")
    found = written(dealt.mapInArrow(run, schema))
    return found.select(F.col("doc").alias(doc), F.col("block").alias(block), "reply", "reason")
