"""Job states over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.operators import jobs


def job_states(events: DataFrame) -> DataFrame:
    """job_id, ok, bad, state: a running aggregate over events(job_id, kind) with kinds done, failed, cancel.  Works on batches
    and, in update or complete mode, on streams."""
    kind = F.col("kind")
    counted = events.groupBy("job_id").agg(F.count_if(kind == "done").alias("ok"), F.count_if(kind == "failed").alias("bad"), F.max(kind == "cancel").alias("cancelled"))
    return counted.select("job_id", "ok", "bad", jobs.state(F.col("cancelled"), F.col("ok"), F.col("bad")).alias("state"))
