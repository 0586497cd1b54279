"""The driver's tables seen as library data, for Spark and (SQL) for its check."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.functions import flac
from tracklight.functions import time as tm
from tracklight.functions.udfs import pandas_udf
from tracklight.operators.ranges import frame_starts
from tracklight.sources.store import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows stand for much work each, dealt to all tasks: a file of millions of short rows is one split."""
    return spread(table(spark, sf_dir, name), key)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is an album and a turn a track of 1000 samples for each character."""
    length = F.length("text").cast("bigint") * 1000
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("album_id"), F.col("turn").alias("track_index"), F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start"), F.sum(length).over(Window.partitionBy("conv_id")).cast("bigint").alias("total"))


TRACKS = """tracks as (select conv_id as album_id, turn as track_index, length(text)::bigint * 1000 as len,
  coalesce(sum(length(text)::bigint * 1000) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start,
  (sum(length(text)::bigint * 1000) over (partition by conv_id))::bigint as total from conversations)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file and its lines are frames of 100 samples for each piece, ten bytes for each piece."""
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 100).cast("bigint").alias("sample_count"), (F.col("l_quantity") * 10).cast("bigint").alias("byte_length"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy("file_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame_starts(blocks, "file_id", order).withColumn("byte_offset", F.coalesce(F.sum("byte_length").over(w), F.lit(0)).cast("bigint")).select("file_id", "frame_index", "start_sample", "sample_count", "byte_offset", "byte_length")


FRAMES = """frames as materialized (select l_orderkey as file_id, (row_number() over w - 1)::bigint as frame_index, (l_quantity * 100)::bigint as sample_count, (l_quantity * 10)::bigint as byte_length,
  (coalesce(sum((l_quantity * 100)::bigint) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as start_sample,
  (coalesce(sum((l_quantity * 10)::bigint) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as byte_offset
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
totals as materialized (select file_id, sum(sample_count)::bigint as total, count(*) as n, sum(byte_length)::bigint as bytes from frames group by 1),
bounds as materialized (select file_id, start_sample as sample, frame_index, byte_offset from frames union all select file_id, total, n, bytes from totals)"""


def quarters(frames_: DataFrame) -> DataFrame:
    """Four ranges that tile each file."""
    total = frames_.groupBy("file_id").agg(F.sum("sample_count").cast("bigint").alias("total"))
    q = F.expr("total div 4")
    return total.select("file_id", "total", F.explode(F.array(*(F.struct(F.lit(i).alias("q"), (q * i).alias("lo"), (q * (i + 1) if i < 3 else F.col("total")).alias("hi")) for i in range(4)))).alias("r")).select("file_id", "r.q", "r.lo", "r.hi", "total")


QUARTERS = """quarters as materialized (select file_id, q, (total // 4) * q as lo, case when q < 3 then (total // 4) * (q + 1) else total end as hi, total
  from totals, (select unnest([0, 1, 2, 3]) as q))"""


def library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """audio, cues and embedded from parts: even keys are audio, odd ones sheets; names are part names and sizes."""
    p = table(spark, sf_dir, "part")
    name, key = F.concat_ws("-", "p_name", F.col("p_size").cast("string")), F.col("p_partkey")
    audio = p.where("p_partkey % 2 = 0").select(key.alias("scan_pos"), F.concat(F.lit("/m/"), "p_brand", F.lit("/"), name, F.lit(".flac")).alias("path"), F.concat(name, F.lit(".flac")).alias("file_name"), F.concat(F.lit("/m/"), "p_brand", F.lit("/")).alias("dir"))
    other = F.concat_ws("-", "p_name", (F.col("p_size") % 7).cast("string"))
    cues = p.where("p_partkey % 2 = 1").select(key.alias("cue_pos"), F.concat(F.lit("/m/"), "p_brand", F.lit("/"), name, F.lit(".cue")).alias("cue_path"), F.concat(name, F.lit(".cue")).alias("cue_name"), F.concat(F.lit("/m/"), "p_brand").alias("cue_dir"), F.array(F.concat(other, F.lit(".flac"))).alias("files"))
    embedded = audio.groupBy("path").agg(F.min("scan_pos").alias("k")).where("k % 3 <> 0").select("path", (F.col("k") % 3 == 1).alias("parse_ok"))
    return audio, cues, embedded


LIBRARY = """audio as materialized (select p_partkey as scan_pos, p_brand as d, p_name || '-' || p_size as name from part where p_partkey % 2 = 0),
cues as materialized (select p_partkey as cue_pos, p_brand as d, p_name || '-' || p_size as name, p_name || '-' || (p_size % 7) as entry from part where p_partkey % 2 = 1),
embedded as materialized (select d, name, min(scan_pos) % 3 = 1 as parse_ok from audio group by 1, 2 having min(scan_pos) % 3 <> 0),
a1 as materialized (select lower(name) as key, min(scan_pos) as scan_pos from audio group by 1),
c1 as materialized (select lower(name) as key, list(cue_pos order by cue_pos) as cs from cues group by 1),
p1 as materialized (select scan_pos, cs from a1 join c1 using (key)),
u1 as (select unnest(cs) as cue_pos from p1),
a2 as materialized (select * from audio where scan_pos not in (select scan_pos from p1)),
c2 as materialized (select * from cues where cue_pos not in (select cue_pos from u1)),
g2 as materialized (select lower(a2.d) as d, lower(a2.name) as name, min(scan_pos) as scan_pos, list(distinct cue_pos order by cue_pos) as cs
       from a2 join c2 on lower(a2.d) = lower(c2.d) and lower(a2.name) = lower(c2.entry) group by 1, 2),
p2 as materialized (select scan_pos, cs from g2),
u2 as (select unnest(cs) as cue_pos from p2),
a3 as materialized (select * from a2 where scan_pos not in (select scan_pos from p2)),
c3 as materialized (select * from c2 where cue_pos not in (select cue_pos from u2)),
p3 as materialized (select d, ss, cs from (select lower(d) as d, list(scan_pos order by scan_pos) as ss from a3 group by 1) join (select lower(d) as d, list(cue_pos order by cue_pos) as cs from c3 group by 1) using (d)),
u3 as materialized (select unnest(ss) as scan_pos, ss, cs from p3),
p4 as materialized (select a3.scan_pos, e.parse_ok from a3 left join embedded e on a3.d = e.d and a3.name = e.name where a3.scan_pos not in (select scan_pos from u3)),
matches as materialized (
 select scan_pos, 1 as pass, case when len(cs) = 1 then 'matched' else 'ambiguous' end as outcome, case when len(cs) = 1 then 'Basename' end as rule, null as reason, cs from p1
 union all select scan_pos, 2, case when len(cs) = 1 then 'matched' else 'ambiguous' end, case when len(cs) = 1 then 'CueFileDirective' end, null, cs from p2
 union all select u3.scan_pos, 3, case when len(ss) = 1 and len(cs) = 1 then 'matched' else 'ambiguous' end, case when len(ss) = 1 and len(cs) = 1 then 'UniquePairInDirectory' end, null, cs from u3
 union all select scan_pos, 4, case when parse_ok then 'matched' else 'unmatched' end, case when parse_ok then 'EmbeddedCue' end, case when parse_ok is null then 'No external or embedded CUE' when not parse_ok then 'Embedded CUE failed to parse' end, [] from p4)"""


def sheets(spark, sf) -> DataFrame:
    """A sheet text for each conversation."""
    mmssff = lambda n: F.format_string("%02d:%02d:%02d", tm.div(n, 4500), tm.div(n, 75) % 60, n % 75)
    line = F.concat(F.lit("  TRACK "), F.lpad((F.col("track_index") % 90 + 1).cast("string"), 2, "0"), F.lit(' AUDIO\n    TITLE "Turn '), F.col("track_index").cast("string"), F.lit('"\n    INDEX 01 '), mmssff(tm.div(F.col("start"), 1000)))
    rows = tracks(spark, sf).select("album_id", "track_index", line.alias("line")).groupBy("album_id").agg(F.array_sort(F.collect_list(F.struct("track_index", "line"))).alias("l"))
    return rows.select("album_id", F.concat(F.lit('REM DATE 1999\nTITLE "Album '), F.col("album_id").cast("string"), F.lit('"\nFILE "a b.flac" WAVE\n'), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("text"))


def head_bytes(rate: int, channels: int, bits: int, total: int, tag: str) -> bytes:
    """A head without frames.  STREAMINFO has 36 bits for the samples: a longer stream says 0 there (unknown, by the format) and
    has its count in a comment, where total_samples() finds it."""
    info = {"min_block": 4096, "max_block": 4096, "min_frame": 0, "max_frame": 0, "sample_rate": rate, "channels": channels, "bits_per_sample": bits}
    return flac.container(info | {"total_samples": total if total < 1 << 36 else 0}, [tag] if total < 1 << 36 else [tag, f"{LONG_TOTAL}={total}"])


@pandas_udf("binary")
def flac_header(rate, channels, bits, total, tag):
    """head_bytes() of each row."""
    import pandas as pd

    return pd.Series([head_bytes(int(r), int(c), int(b), int(n), t) for r, c, b, n, t in zip(rate, channels, bits, total, tag, strict=True)])


#: The comment that holds a count of samples beyond STREAMINFO's 36 bits.
LONG_TOTAL = "TOTALSAMPLES"


def total_samples(total: Column, comments: Column) -> Column:
    """The samples of a stream by its STREAMINFO, or by its comment where that says 0."""
    said = F.try_element_at(F.filter(comments, lambda c: F.upper(c["k"]) == LONG_TOTAL), F.lit(1))["v"].try_cast("bigint")
    return F.when(total == 0, F.coalesce(said, total)).otherwise(total)


#: Any body of up to 256 bytes more than 64 KB, whatever its first byte.
_BODIES = bytes(range(256)) * 258
#: Frames are of few sizes, so that those of the usual numbers are made once.
_made_frame = functools.lru_cache(50_000)(lambda b, i: flac.make_frame(b, i, _BODIES[b % 256 : b % 256 + b // 10]))


def flac_bytes(blocks: list[int]) -> bytes:
    """A file with frames of so many samples, ten to a byte."""
    audio = b"".join(map(_made_frame, blocks, range(len(blocks))))
    info = {"min_block": min(blocks), "max_block": max(blocks), "min_frame": 0, "max_frame": 0, "sample_rate": 44_100, "channels": 2, "bits_per_sample": 16, "total_samples": sum(blocks)}
    return flac.container(info, [], audio)


@pandas_udf("binary")
def encoded(samples):
    """What an encoder would make of so many samples: a file of one frame."""
    import pandas as pd

    return pd.Series([_one_frame(int(n)) if n == n and n is not None else None for n in samples])


@functools.lru_cache(50_000)
def _one_frame(n: int) -> bytes:
    info = {"min_frame": 0, "max_frame": 0, "sample_rate": 44_100, "channels": 2, "bits_per_sample": 16}
    return flac.container(info | {"min_block": n, "max_block": n, "total_samples": n}, [], flac.make_frame(n, 0, b"edge"))
