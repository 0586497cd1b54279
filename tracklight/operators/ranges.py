"""Track ranges and running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.time import div


def track_ranges(tracks: DataFrame, album: str = "album_id") -> DataFrame:
    """start_sample and end_sample of each track from `start` (null: no index) and `total` of its album: a track ends where the
    next begins or the album ends; both lie within the album and no range is negative.  Tracks without a start fail the
    album: its rows carry `error`."""
    w = Window.partitionBy(album).orderBy("track_index")
    clamp = lambda c: F.greatest(F.lit(0).cast("bigint"), F.least(c, F.col("total")))
    start = clamp(F.col("start"))
    end = F.greatest(start, clamp(F.lead("start", 1).over(w)))
    broken = F.max(F.col("start").isNull()).over(Window.partitionBy(album))
    last = F.lead(F.lit(1)).over(w).isNull()
    return tracks.select("*", start.alias("start_sample"), F.when(last, F.greatest(start, F.col("total"))).otherwise(end).alias("end_sample"), F.when(broken, "track without INDEX").alias("error"))


def duration_ms(start: F.Column, end: F.Column, rate: int) -> F.Column:
    return div((end - start) * 1000, rate)


def frame_starts(blocks: DataFrame, key: str, order: list[str], base_sample: int = 0, base_index: int = 0) -> DataFrame:
    """frame_index and start_sample (exclusive running sum of sample_count) of each block of a file."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.sum("sample_count").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumns({"frame_index": (F.row_number().over(w) - 1 + base_index).cast("bigint"), "start_sample": (F.coalesce(before, F.lit(0)) + base_sample).cast("bigint")})
