"""Streams against their batch forms."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import barkgraph.queries as Q
from barkgraph import file_queries
from barkgraph.file_queries import in_batches
from barkgraph.operators import trackers
from barkgraph.operators.fusion import fused
from barkgraph.streaming import windows
from barkgraph.streaming.windows import bursts, fused_stream, tumbling_counts

SF = "/root/testdata/sf0.001"


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_counts_as_in_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = drained(tumbling_counts(stream, "1 hour"), "counts", "complete")
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(tumbling_counts(events, "1 hour"))


def test_bursts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(seconds=5)), (1, t + dt.timedelta(seconds=60)), (2, t)]
    got = sorted((r.video_id, r.n) for r in bursts(spark.createDataFrame(rows, "video_id long, ts timestamp"), "10 seconds").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_fusion_as_in_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(12):
        s = float(i)
        rows.append((t + dt.timedelta(seconds=s + 1), i % 2, i, s, s + 1.0, "dog_1" if i % 3 == 0 else None, [1.0, 0.1 * (i % 3)] if i % 4 else [0.0, 1.0]))
    rows.append((t + dt.timedelta(hours=1), 9, 99, 0.0, 0.1, None, [1.0, 0.0]))  # lets the watermark pass the others
    schema = "ts timestamp, video_id long, event_id long, start double, end double, visual_profile string, vector array<double>"
    events = spark.createDataFrame(rows, schema)
    for k in range(2):  # a second file, so that a batch follows the one that moves the watermark
        events.where(f"(event_id = 99) = ({k} = 1)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f")
    got = drained(fused_stream(stream), "fusion", "append")
    key = lambda df: sorted((r.video_id, r.event_id, r.all_dog_profile_id, r.v2_decision) for r in df.where("event_id <> 99").collect())
    want = key(fused(events))
    assert want and key(got) == want


def test_registered_stream_as_the_batch(spark):
    key = lambda name: sorted(map(repr, Q.queries()[name](spark, SF).collect()))
    assert key("SS03_fused_stream") == key("ST03_fusion")


@pytest.mark.parametrize("method, vector, detector", [("stable", "v", "track_id"), ("bytetrack", None, None)])
def test_tracking_as_in_batch(spark, method, vector, detector):
    seen = Q._seen(Q.Tables(spark, SF)).where("frame < 900 and video_id < 3")
    rows = seen.withColumn("ts", F.timestamp_seconds(3600 + F.col("frame") / 10)).cache()
    stream = in_batches(spark, rows, [F.timestamp_seconds(F.lit(s)) for s in (3620, 3650, 3651)], rows.schema)
    got = windows.drained(windows.tracked_stream(stream, method, vector=vector, detector=detector)).where("video_id >= 0")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(trackers.tracked(seen, method, vector, detector))
    assert key(got) == want and len(want) > 500


class Handle:
    """State in dictionaries, which counts what is read and written."""

    def __init__(self):
        self.timers, self.work = set(), 0

    def getMapState(self, name, key, value):
        handle, data = self, {}

        class Map:
            def containsKey(self, k):
                return k in data

            def getValue(self, k):
                handle.work += 1
                return data[k]

            def updateValue(self, k, v):
                handle.work += 1
                data[k] = v

            def removeKey(self, k):
                del data[k]

            def keys(self):
                return iter(list(data))

            def iterator(self):
                handle.work += len(data)
                return iter(list(data.items()))

        return Map()

    def getValueState(self, name, kind):
        class Value:
            held = None

            def exists(self):
                return self.held is not None

            def get(self):
                return self.held

            def update(self, v):
                self.held = v

            def clear(self):
                self.held = None

        return Value()

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_state_work_grows_with_the_events():
    def work(n):
        handle, p, out = Handle(), windows.FusionProcessor(), []
        p.init(handle)
        rows = pd.DataFrame([(pd.Timestamp(i, unit="s", tz="UTC"), i, float(i), i + 1.0, f"dog_{i % 4}", [1.0, i % 4]) for i in range(n)], columns=["ts", *p.columns])
        list(p.handleInputRows((1,), iter([rows.sample(frac=1, random_state=1)]), None))
        assert len(handle.timers) == 1
        for at in range(0, n * 1000 + 200_000, 100_000):  # the watermark moves by a hundred events
            for t in [t for t in handle.timers if t < at]:
                out += [r for f in p.handleExpiredTimer((1,), Now(at), Now(t)) for r in f.event_id]
                handle.timers.discard(t)
        assert out == list(range(n)) and not handle.timers
        return handle.work

    assert work(4000) < 4.2 * work(1000)


def test_rows_that_wait_are_folded_a_few_at_a_time(monkeypatch):
    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Map(dict):
        def updateValue(self, k, v): self[k] = v
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]
        def keys(self): return list(super().keys())

    class Handle:
        def getMapState(self, *_): return Map()
        def getValueState(self, *_): return Value()
        def registerTimer(self, _): pass
        def deleteTimer(self, _): pass

    class Clock:
        def getCurrentWatermarkInMs(self): return 40_000
        def getExpiryTimeInMs(self): return 1

    class Seen(windows.InOrder):
        columns, output = ("n",), "n long"
        def fold(self, key, rows): return sorted(rows)

    monkeypatch.setattr(windows, "AT_ONCE", 100)
    p = Seen()
    p.init(Handle())
    frame = lambda a, b: pd.DataFrame({"ts": pd.to_datetime([n // 10 for n in range(a, b)], unit="s", utc=True), "n": range(a, b)})
    list(p.handleInputRows((1,), iter([frame(0, 255), frame(255, 500)]), None))
    out = list(p.handleExpiredTimer((1,), Clock(), Clock()))
    assert [n for f in out for n in f.n] == list(range(400)) and max(map(len, out)) == 100
    assert {k[0] for k in p.waiting.keys()} == {s * 1000 for s in range(40, 50)} and p.least.get() == (40_000,)


def test_rows_that_come_in_many_frames_are_stored_together():
    """The calls of the state go with the rows held at once and their times, not with the frames in which they come."""
    handle, p = Handle(), windows.FusionProcessor()
    p.init(handle)
    rows = [(pd.Timestamp(i % 5, unit="s"), i, float(i % 5), i % 5 + 1.0, None if i % 3 else "dog", np.array([1.0, i % 4])) for i in range(400)]
    frames = [pd.DataFrame(rows[k : k + 20], columns=["ts", *p.columns]) for k in range(0, 400, 20)]
    list(p.handleInputRows((1,), iter(frames), None))
    assert handle.work == 5
    got = [r for f in p.handleExpiredTimer((1,), Now(10**6), Now(1)) for r in f.event_id]
    assert got == [i for t in range(5) for i in range(t, 400, 5)]


def test_large_batches_are_several_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(file_queries, "FILE_ROWS", 30)
    monkeypatch.setattr(file_queries, "scratch", lambda _: f"{tmp_path}/rows")
    rows = spark.range(0, 360).select(F.col("id").alias("video_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    stream = in_batches(spark, rows, [F.timestamp_seconds(F.lit(s)) for s in (100, 260)], rows.schema)
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 3 * 3 + 1
    q = stream.writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [100, 160, 100, 1]
