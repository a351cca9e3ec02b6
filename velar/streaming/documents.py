"""Documents that are held for a while: put, touched, deleted, and forgotten when nobody asks for them.

The state of a document is one value, and one timer says when it goes: `minutes` after it was last put or touched. Time
is that of the events, so that a replay gives the same rows; a timer fires once the watermark has passed it. A document
that was deleted or has expired leaves no state behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Fixed setting: the store that keeps timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD = StructType([StructField("opened", LongType()), StructField("touched", LongType()), StructField("goes", LongType()), StructField("days", IntegerType())])
ROWS = "doc string, event string, at long, opened long, days int"


class Holder(StatefulProcessor):
    """What happens to one document; times are milliseconds since 1970.

    The state is read once and written once for all events of a document in a batch: each access is a message to the JVM.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("document", HELD)

    def _store(self, before: tuple | None, held: tuple | None) -> None:
        """The document as it is now, and the one timer that it needs."""
        goes, went = (x[2] if x is not None else None for x in (held, before))
        if went is not None and went != goes:
            self.handle.deleteTimer(went)
        if held is not None and held != before:
            self.state.update(held)
        if goes is not None and goes != went:
            self.handle.registerTimer(goes)
        if held is None and before is not None:
            self.state.clear()

    def handled(self, doc: str, events: list[tuple[int, str, int | None]]) -> list[tuple[str, str, int, int | None, int | None]]:
        """A row (doc, event, at, opened, days) for each event of a document, in order of time."""
        before = tuple(self.state.get()) if self.state.exists() else None
        held, out = before, []  # opened, touched, goes, days
        for at, action, days in sorted(events, key=lambda e: (e[0], e[1])):
            if held is not None and at >= held[2]:  # it went before this came
                out.append((doc, "expired", held[2], held[0], held[3]))
                held = None
            if action == "put":
                held = (at, at, at + self.keep, days) if held is None else (held[0], at, at + self.keep, held[3])
                out.append((doc, "put", at, held[0], held[3]))
            elif held is None:
                out.append((doc, "unknown", at, None, None))
            elif action == "touch":
                if at > held[1]:
                    held = (held[0], at, at + self.keep, held[3])
                out.append((doc, "touch", at, held[0], held[3]))
            elif action == "delete":
                out.append((doc, "deleted", at, held[0], held[3]))
                held = None
            else:
                out.append((doc, "unknown", at, held[0], held[3]))
        self._store(before, held)
        return out

    @staticmethod
    def _frame(rows: list[tuple]):
        import pandas as pd

        columns = zip(*rows) if rows else ((),) * 5
        types = ("object", "object", "int64", "Int64", "Int32")
        return pd.DataFrame({n: pd.array(c, t) if t[0] == "I" else pd.Series(c, dtype=t) for n, c, t in zip(("doc", "event", "at", "opened", "days"), columns, types)})

    def handleInputRows(self, key, rows, timerValues):
        events: list[tuple[int, str, int | None]] = []
        for part in rows:
            days = [None if n is None or n != n else int(n) for n in part["days"].tolist()]
            events += zip(part["at_ms"].tolist(), part["action"].tolist(), days)
        yield self._frame(self.handled(key[0], events))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and (held := self.state.get())[2] <= at:
            self.state.clear()
            yield self._frame([(key[0], "expired", held[2], held[0], held[3])])

    def close(self) -> None:
        pass


def held_documents(events: DataFrame, minutes: int = 30, late: str = "0 seconds") -> DataFrame:
    """(doc, event, at, opened, days) from a stream of (doc, at, action, days): what happened to each document.

    action is put, touch or delete; other ones, and those that meet no open document, come out as `unknown`. A document
    is expired `minutes` after its last put or touch. days is the shift of its dates: that of the first put stays as long
    as the document is open, and a new put after it went takes a new one. Rows with a null doc, time or action are left
    out; events more than `late` behind the latest one are dropped, as the watermark says. Documents are dealt by id, a
    document's events of one batch are sorted by time and held together. The session must use the store in STORE.
    """
    timed = events.where("doc is not null and at is not null and action is not null").withWatermark("at", late)
    rows = timed.select(F.col("doc").cast("string").alias("doc"), "at", F.unix_millis("at").alias("at_ms"), "action", F.col("days").cast("int").alias("days"))
    told = rows.groupBy("doc").transformWithStateInPandas(statefulProcessor=Holder(minutes * 60_000), outputStructType=ROWS, outputMode="append", timeMode="eventTime")
    return told.select("doc", "event", *[F.timestamp_millis(c).alias(c) for c in ("at", "opened")], "days")
