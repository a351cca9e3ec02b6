"""Detection on a stream of text blocks, and documents that expire."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velar.operators import detect, redact


def redacted_stream(blocks: DataFrame, categories: Iterable[str] | None = None, days: Column | None = None, dates: str = "block", ages: str = "block", text_col: str = "text") -> DataFrame:
    """The stream with `language`, `spans` and `redacted`: the same row-wise expressions as in a batch, no state."""
    return redact.redacted(detect.with_spans(blocks, categories, text_col=text_col), days, dates, ages, text_col=text_col)


def open_documents(touches: DataFrame, doc: str, at: str, minutes: int = 30) -> DataFrame:
    """(doc, opened, closes, touches): a document stays open until `minutes` after it was last touched.

    A session window per document; its state goes with the watermark, so that what expired is forgotten.
    """
    held = touches.withWatermark(at, f"{minutes} minutes").groupBy(doc, F.session_window(at, f"{minutes} minutes").alias("w"))
    return held.agg(F.count(F.lit(1)).alias("touches")).select(doc, F.col("w.start").alias("opened"), F.col("w.end").alias("closes"), "touches")
