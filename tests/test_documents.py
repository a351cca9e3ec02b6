import datetime as dt
import json

import pytest

from velar.streaming import documents

pytest.importorskip("google.protobuf")
START = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)


def at(minutes):
    return (START + dt.timedelta(minutes=minutes)).isoformat()


@pytest.fixture()
def run(spark, tmp_path):
    """Runs batches of events, a file each, and gives (doc, event, minute, minute it was opened, days)."""
    before = spark.conf.get(documents.STORE[0])
    spark.conf.set(*documents.STORE)

    def go(*batches):
        for k, events in enumerate(batches):
            (tmp_path / "in").mkdir(exist_ok=True)
            lines = [json.dumps({"doc": d, "at": at(m), "action": a, "days": n}) for d, m, a, n in events]
            (tmp_path / "in" / f"{k:03}.json").write_text("\n".join(lines))
            import os

            os.utime(tmp_path / "in" / f"{k:03}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema("doc string, at timestamp, action string, days int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = documents.held_documents(stream, minutes=30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        minute = lambda t: None if t is None else (t.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / 60
        rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("doc", "event", "cast(at as timestamp_ntz) as at", "cast(opened as timestamp_ntz) as opened", "days").collect()
        return sorted(((r.doc, r.event, minute(r.at), minute(r.opened), r.days) for r in rows), key=lambda r: (r[0], r[2], r[1]))

    yield go
    spark.conf.set(documents.STORE[0], before)


def test_put_touch_delete_and_expiry(run):
    got = run(
        [("a", 0, "put", 40), ("b", 1, "put", -50), ("c", 2, "put", 60), ("x", 3, "touch", None)],
        [("a", 20, "touch", None), ("c", 21, "delete", None), ("c", 22, "touch", None)],
        [("a", 45, "put", 99)],
        [("clock", 60, "put", 1)],  # time goes on: b went at minute 31
        [("clock", 80, "touch", 1)],  # a at 75
        [("a", 90, "put", 77), ("b", 91, "touch", None), ("a", 92, "odd", None)],
    )
    assert [r for r in got if r[0] == "a"] == [("a", "put", 0, 0, 40), ("a", "touch", 20, 0, 40), ("a", "put", 45, 0, 40), ("a", "expired", 75, 0, 40), ("a", "put", 90, 90, 77), ("a", "unknown", 92, 90, 77)]
    assert [r for r in got if r[0] == "b"] == [("b", "put", 1, 1, -50), ("b", "expired", 31, 1, -50), ("b", "unknown", 91, None, None)]
    assert [r for r in got if r[0] == "c"] == [("c", "put", 2, 2, 60), ("c", "deleted", 21, 2, 60), ("c", "unknown", 22, None, None)]
    assert [r for r in got if r[0] == "x"] == [("x", "unknown", 3, None, None)]


def test_events_of_one_batch_and_nulls(run):
    got = run([("a", 70, "touch", None), ("a", 0, "put", 5), ("a", 10, "touch", None), (None, 1, "put", 3), ("z", 1, None, 3)])
    assert got == [("a", "put", 0, 0, 5), ("a", "touch", 10, 0, 5), ("a", "expired", 40, 0, 5), ("a", "unknown", 70, None, None)]


def test_state_is_read_and_written_once_for_a_batch():
    calls = []

    class Fake:
        value = None

        def getValueState(self, *_):
            return self

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("no timer", at))

    fake, holder = Fake(), documents.Holder(1000)
    holder.init(fake)
    rows = list(holder.handled("a", [(k * 600, "put", k) for k in range(100)] + [(70_000, "put", 7), (70_001, "delete", None), (70_002, "put", 8)]))
    assert len(rows) == 103 + 1 and fake.value == (70_002, 70_002, 71_002, 8) and calls == ["exists", "update", ("timer", 71_002)]
    calls.clear()
    list(holder.handled("a", [(70_500, "touch", None), (70_600, "touch", None)]))
    assert fake.value == (70_002, 70_600, 71_600, 8) and calls == ["exists", "get", ("no timer", 71_002), "update", ("timer", 71_600)]
    calls.clear()
    list(holder.handled("a", [(80_000, "touch", None)]))
    assert fake.value is None and calls == ["exists", "get", ("no timer", 71_600), "clear"]
