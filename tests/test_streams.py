"""Job events on streams: the state machine against the stored log, idle grace on the events' clock, listeners."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracklight.operators import jobs
from tracklight.streaming import listeners
from tracklight.streaming.idle import idle_stops
from tracklight.streaming.machine import EVENTS, TERMINAL, current, run, transitions

KINDS = ("enqueue", "start", "track_ok", "track_failed", "finish", "error", "cancel", "retry", "nonsense")


def log(n=40, seed=3):
    """Events of jobs, one of them with a third of all."""
    rng = random.Random(seed)
    out = []
    for j in range(n):
        for i in range(10 * n if j == 0 else rng.randint(1, 30)):
            out.append((f"j{j}", i, "enqueue" if i == 0 and j % 5 else rng.choice(KINDS), 10, f"m{i}"))
    return out


def batches(spark, folder, events, n):
    """Files of the log in its order, read one at a time."""
    for b in range(n):
        spark.createDataFrame([e for e in events if e[1] * n // (max(x[1] for x in events) + 1) == b], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_machine_by_hand():
    job = {"state": None, "completed": 0, "good": 0, "bad": 0, "total": 0, "flagged": False, "progress": 0.0, "message": None, "seq": -1}
    kinds = ["start", "enqueue", "enqueue", "start", "track_ok", "track_failed", "cancel", "track_ok", "finish", "finish", "retry", "cancel", "start", "retry"]
    _, out = run(job, list(range(len(kinds))), kinds, [4] * len(kinds), [None] * len(kinds))
    assert [(r["accepted"], r["state"]) for r in out] == [(False, None), (True, "Pending"), (False, "Pending"), (True, "Running"), (True, "Running"), (True, "Running"), (True, "Cancelling"), (True, "Cancelling"), (True, "PartialSuccess"), (False, "PartialSuccess"), (True, "Pending"), (True, "Cancelling"), (False, "Cancelling"), (False, "Cancelling")]
    assert [round(r["progress"], 6) for r in out[3:8]] == [0.0, 0.31, 0.54, 0.54, 0.77]
    _, again = run(dict(job, seq=5), [3, 6], ["enqueue", "enqueue"], [1, 1], [None, None])
    assert [r["accepted"] for r in again] == [False, True]


@pytest.mark.parametrize(("kinds", "state"), [(["start", "cancel", "finish"], "Cancelled"), (["start", "cancel", "track_ok", "finish"], "Succeeded"), (["start", "finish"], "Failed"), (["start", "error"], "Failed"), (["start", "cancel", "error"], "Cancelled"), (["cancel"], "Cancelling")])
def test_ends(kinds, state):
    kinds = ["enqueue", *kinds]
    job, _ = run({"state": None, "completed": 0, "good": 0, "bad": 0, "total": 0, "flagged": False, "progress": 0.0, "message": None, "seq": -1}, list(range(len(kinds))), kinds, [1] * len(kinds), [None] * len(kinds))
    assert job["state"] == state


def test_stream_and_log_agree(spark, tmp_path):
    events = log()
    random.Random(1).shuffle(events)
    batch = {(r.job_id, r.seq): tuple(r) for r in transitions(spark.createDataFrame([*events, (None, 1, "start", 1, None), ("x", None, "start", 1, None)], EVENTS)).collect()}
    assert len(batch) == len(events)
    stream = transitions(batches(spark, tmp_path / "in", events, 4))
    q = stream.writeStream.format("memory").queryName("moved").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.job_id, r.seq): tuple(r) for r in spark.table("moved").collect()}
    assert got == batch
    newest = {r.job_id: r.state for r in current(transitions(spark.createDataFrame(events, EVENTS))).collect()}
    assert newest == {j: batch[j, max(s for k, s in batch if k == j)][3] for j in newest}


def test_late_listener_gets_each_row_once(spark, tmp_path):
    events, state = log(12), str(tmp_path / "state")
    source = batches(spark, tmp_path / "in", [e for e in events if e[1] < 8], 2)
    sink = listeners.Increments(str(tmp_path / "out"))

    def go(stream):
        q = transitions(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    go(source)
    before = {r.job_id: (r.state, r.seq) for r in current(spark.read.parquet(sink.folder)).collect()}
    now, more = listeners.subscribe(spark, state, sink)
    snapshot = {r.job_id: (r.state, r.seq) for r in now.collect()}
    assert snapshot == before
    spark.createDataFrame([e for e in events if e[1] >= 8], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go(source)
    later = more().collect()
    assert {(r.job_id, r.seq) for r in later} == {(e[0], e[1]) for e in events if e[1] >= 8} and len(later) == sum(e[1] >= 8 for e in events)
    assert {**{r.job_id: r.seq for r in now.collect()}, **{r.job_id: r.seq for r in current(more()).collect()}} == {j: max(e[1] for e in events if e[0] == j) for j in {e[0] for e in events}}


def test_throttle(spark):
    clock, told = [100.0], []
    rows = lambda *r: spark.createDataFrame([(j, i, s, True) for i, (j, s) in enumerate(r, rows.n)], "job_id string, seq long, state string, accepted boolean")
    rows.n = 0
    t = listeners.Throttle(lambda df: told.append({r.job_id: r.state for r in df.collect()}), clock=lambda: clock[0], timer=False)
    t(rows(("a", "Running")), 0)
    assert told == [{"a": "Running"}]
    rows.n, clock[0] = 10, 100.1
    t(rows(("a", "Cancelling"), ("b", "Pending")), 1)
    t(rows(), 2)
    assert len(told) == 1  # not due yet
    rows.n = 20
    t(rows(("b", "Running"), ("c", "Failed")), 3)
    assert told[1:] == [{"a": "Cancelling", "b": "Running", "c": "Failed"}]  # an end is told at once, with what was waiting
    rows.n, clock[0] = 30, 100.2
    t(rows(("a", "Running")), 4)
    assert len(told) == 2
    rows.n, clock[0] = 40, 100.36
    t(rows(("a", "Pending")), 5)
    assert told[2:] == [{"a": "Pending"}]
    t.flush()
    assert len(told) == 3 and "Succeeded" in TERMINAL


def test_throttle_tells_by_its_timer(spark):
    import threading

    heard, told = threading.Event(), []
    t = listeners.Throttle(lambda df: (told.append(df.count()), len(told) > 1 and heard.set()), every=0.3)
    for i in range(2):
        t(spark.createDataFrame([("a", i, "Running", True)], "job_id string, seq long, state string, accepted boolean"), i)
    assert heard.wait(60) and told == [1, 1]


def test_idle_grace(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(seconds=s)
    schema = "service string, job_id string, active boolean, ts timestamp"
    steps = [
        [("s", "a", True, at(0)), ("s", "b", True, at(1)), ("t", "z", False, at(0))],
        [("s", "a", False, at(5)), ("s", "b", False, at(7))],  # idle from 7
        [("s", "c", True, at(20)), ("s", "c", False, at(21)), ("s", "c", False, at(30))],  # taken back at 20, idle from 21
        [("t", "y", True, at(50)), (None, "q", True, at(50)), ("s", "d", True, None)],
        [("t", "y", True, at(90))],
    ]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = idle_stops(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        if i == 1:
            assert spark.read.parquet(str(tmp_path / "out")).where("service = 's'").count() == 0
    got = sorted((r.service, r.idle_since, r.stopped_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s", at(21), at(36)), ("t", at(0), at(15))]


def test_cancel_of_a_waiting_job(spark):
    known = jobs.enqueue(spark.createDataFrame([("a",), ("b",)], "job_id string"))
    got = {r.job_id: (r.state, r.message) for r in jobs.cancel(known, known.where(F.col("job_id") == "a")).collect()}
    assert got == {"a": ("Cancelling", "cancelling"), "b": ("Pending", "queued")}
