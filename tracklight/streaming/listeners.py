"""Listeners to job states: throttled ones, and ones that join late."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.sources.stored import stored
from tracklight.streaming.machine import TERMINAL, current

#: Seconds between two reports (a fixed value).
EVERY = 0.25


class Throttle:
    """For foreachBatch over the rows of transitions(): tells `post` of the newest state of each job that changed since the last
    report, at most once in `every` seconds, but at once where a job has ended.  What isn't due yet is told by a timer, or by
    flush().  Between reports a batch waits as a written table, so that post gets one DataFrame of any size."""

    def __init__(self, post: Callable[[DataFrame], None], every: float = EVERY, clock: Callable[[], float] = time.monotonic, timer: bool = True) -> None:
        self.post, self.every, self.clock, self.timer = post, every, clock, timer
        self.waiting: list[DataFrame] = []
        self.last, self.lock, self.later = float("-inf"), threading.RLock(), None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with self.lock:
            rows = stored(batch, "changes")
            found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("state").isin(*TERMINAL) & F.col("accepted")), F.lit(False)).alias("ended")).first()
            if not found.n:
                return
            self.waiting.append(rows)
            if found.ended or self.clock() - self.last >= self.every:
                self.flush()
            elif self.timer and self.later is None:
                self.later = threading.Timer(self.every, self.flush)
                self.later.daemon = True
                self.later.start()

    def flush(self) -> None:
        with self.lock:
            if self.later is not None:
                self.later.cancel()
                self.later = None
            if not self.waiting:
                return
            rows, *more = self.waiting
            self.waiting, self.last = [], self.clock()
            for m in more:
                rows = rows.unionByName(m)
            self.post(current(rows))


class Increments:
    """For foreachBatch over the rows of transitions(): each batch is a folder of its own, so that one that is run again takes the
    place of what it wrote before."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Rows of later batches, as far as these are there."""
        return spark.read.parquet(self.folder).where(F.col("batch") > batch_id)


def snapshot(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> tuple[DataFrame, int]:
    """(job_id and its state after a batch, that batch) from a running or stopped query's own state: by default after the last
    batch that was committed.  The state is read where it is kept; no events are run again."""
    if batch_id is None:
        batch_id = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId")).first()[0]
    rows = spark.read.format("statestore").option("stateVarName", "job").option("batchId", batch_id).load(checkpoint)
    return rows.select(F.col("key.job_id").alias("job_id"), "value.*"), batch_id


def subscribe(spark: SparkSession, checkpoint: str, increments: Increments) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """What a late listener gets: the snapshot after the last committed batch, and a function for the rows of all batches after
    it.  A batch is in one of the two, never in both or none."""
    now, batch_id = snapshot(spark, checkpoint)
    return now, lambda: increments.after(spark, batch_id)
