"""When a service may stop: some seconds after its last job has ended, unless another one begins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracklight.streaming.machine import with_state_store

#: Seconds of grace (a fixed value).
GRACE = 15
OUT = "service string, idle_since timestamp, stopped_at timestamp"


class IdleStop(StatefulProcessor):
    """Holds a service's active jobs alone.  As the last one goes a timer is set; a job that becomes active takes it back."""

    def __init__(self, grace: int) -> None:
        self.grace = 1000 * grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "job_id string", "since long")
        self.timer = handle.getValueState("timer", "at long")

    def _any(self) -> bool:
        return next(iter(self.active.keys()), None) is not None

    def _take_back(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def _stop(self, service: str, due: int) -> pd.DataFrame:
        self.timer.clear()
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({"service": [service], "idle_since": [at(due - self.grace)], "stopped_at": [at(due)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ms", kind="stable")
        for job, active, ms in zip(events["job_id"], events["active"], events["ms"], strict=True):
            if self.timer.exists() and ms >= self.timer.get()[0]:
                due = self.timer.get()[0]
                self.handle.deleteTimer(due)
                yield self._stop(key[0], due)
            if active:
                self._take_back()
                self.active.updateValue((job,), (int(ms),))
            else:
                if self.active.containsKey((job,)):
                    self.active.removeKey((job,))
                if not self._any() and not self.timer.exists():
                    due = int(ms) + self.grace
                    self.timer.update((due,))
                    self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.timer.exists() and self.timer.get()[0] == due:
            yield self._stop(key[0], due)

    def close(self) -> None:
        pass


def idle_stops(activity: DataFrame, grace: int = GRACE, late: str = "0 seconds") -> DataFrame:
    """service, idle_since, stopped_at of a stream activity(service, job_id, active, ts): a row for each time that a service has had
    no active job for `grace` seconds by the events' own clock.  A service whose first event is of no active job is idle from
    then on.  late: how far behind the clock events may come."""
    with_state_store(activity.sparkSession)
    rows = activity.where("service is not null and job_id is not null and ts is not null").withWatermark("ts", late)
    timed = rows.select("service", "job_id", F.coalesce("active", F.lit(False)).alias("active"), F.unix_millis("ts").alias("ms"), "ts")
    return timed.groupBy("service").transformWithStateInPandas(IdleStop(grace), OUT, "Append", "EventTime")
