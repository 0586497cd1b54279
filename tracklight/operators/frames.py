"""Frame lookups and hybrid plans, joined on the file first so that ranges only filter within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boundaries(frames: DataFrame, key: str) -> DataFrame:
    """sample, frame_index and byte_offset of every place where a file can be cut: frame starts, and the end."""
    starts = frames.select(key, F.col("start_sample").alias("sample"), F.col("frame_index").cast("bigint").alias("frame_index"), F.col("byte_offset").cast("bigint").alias("byte_offset"))
    ends = frames.groupBy(key).agg(F.max(F.col("start_sample") + F.col("sample_count")).cast("bigint").alias("sample"), F.count(F.lit(1)).alias("frame_index"), F.max(F.col("byte_offset") + F.col("byte_length")).cast("bigint").alias("byte_offset"))
    return starts.unionByName(ends)


def find_boundary(points: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """points(key, sample, …) with frame_index and byte_offset, null where a point is no boundary."""
    return points.join(boundaries(frames, key), [key, "sample"], "left")


def slices(ranges: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """ranges(key, lo, hi, …) with aligned, first_frame, n_frames, byte_offset, byte_length; null where an end is no boundary."""
    b = boundaries(frames, key)
    a = b.select(key, F.col("sample").alias("lo"), F.col("frame_index").alias("f0"), F.col("byte_offset").alias("b0"))
    z = b.select(key, F.col("sample").alias("hi"), F.col("frame_index").alias("f1"), F.col("byte_offset").alias("b1"))
    joined = ranges.join(a, [key, "lo"], "left").join(z, [key, "hi"], "left")
    both = F.col("f0").isNotNull() & F.col("f1").isNotNull() & (F.col("hi") >= F.col("lo"))
    return joined.select(*ranges.columns, both.alias("aligned"), F.when(both, F.col("f0")).alias("first_frame"), F.when(both, F.col("f1") - F.col("f0")).alias("n_frames"), F.when(both, F.col("b0")).alias("byte_offset"), F.when(both, F.col("b1") - F.col("b0")).alias("byte_length"))


def covering(ranges: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Each range (key, lo, hi, …) with the frames that overlap it."""
    f = frames.select(key, "frame_index", F.col("start_sample").alias("fs"), (F.col("start_sample") + F.col("sample_count")).alias("fe"))
    return ranges.join(f, key).where("fs < hi and fe > lo")


def hybrid_plan(ranges: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Ranges (key, lo, hi) with lead_end (the leading part's end), first_mid, n_mid, trail_start; null where there is no such
    part.  Ranges that are empty or go beyond the file have no row."""
    total = frames.groupBy(key).agg(F.max(F.col("start_sample") + F.col("sample_count")).alias("total"))
    inside = (F.col("fs") >= F.col("lo")) & (F.col("fe") <= F.col("hi"))
    hit = covering(ranges.join(total, key).where("lo < hi and hi <= total and lo >= 0").drop("total"), frames, key)
    got = hit.groupBy(key, "lo", "hi").agg(F.min("fs").alias("first_fs"), F.min_by("fe", "fs").alias("first_fe"), F.max("fs").alias("last_fs"), F.max("fe").alias("last_fe"), F.min(F.when(inside, F.col("frame_index"))).alias("first_mid"), F.count_if(inside).alias("n_mid"))
    single = F.col("first_fs") == F.col("last_fs")
    leads = (F.col("first_fs") < F.col("lo")) | (single & (F.col("first_fe") > F.col("hi")))
    trails = ~single & (F.col("last_fe") > F.col("hi"))
    return got.select(key, "lo", "hi", F.when(leads, F.least("first_fe", "hi")).cast("bigint").alias("lead_end"), F.col("first_mid").cast("bigint").alias("first_mid"), F.col("n_mid").cast("bigint").alias("n_mid"), F.when(trails, F.col("last_fs")).cast("bigint").alias("trail_start"))
