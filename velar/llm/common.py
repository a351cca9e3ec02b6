"""What several operators share: word bytes, written intermediate tables, hashing of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velar.sources.tables import scratch, written  # noqa: F401

#: Byte tables. A word of kind "space" is a run without \x20 and \x09-\x0D, which is what bytes.split() yields.
#: A word of kind "letters" is a run of digits, a-z and every non-ASCII byte, after A-Z became a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BATCH_BYTES = 8 << 20
#: Turns \x09-\x0D into \x20.
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to Python at once, where the session has Spark's own 64 MB.

    Up to eight workers of an executor would hold that much, and what they make of it, together.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns keep, and the text as bytes, with no other column of docs."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(quoted(c)).alias(c) for c in keep], F.col(quoted(text_col)).cast("binary").alias("text"))


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct with fields of our own names, so that none can clash."""
    return F.struct(F.lit(0).alias("c"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])


def unpacked(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of docs from `row`, which packed() made, and a binary `text`."""
    return [(F.col("text").cast("string") if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def binaries(column: pa.Array) -> list[bytes]:
    """Python bytes of a column; null becomes empty."""
    return [x or b"" for x in column.to_pylist()]


def word_pieces(text: bytes, table: bytes | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of text after translation by table, in order, from pieces of about size bytes that end at a space."""
    if len(text) <= size:
        yield (text.translate(table) if table else text).split()
        return
    text = text.translate(table) if table else text.translate(SPACES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
