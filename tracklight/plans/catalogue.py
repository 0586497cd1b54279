"""The query catalogue: each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.functions import charset, cue, flac
from tracklight.functions import text as T
from tracklight.functions import time as tm
from tracklight.functions.udfs import pandas_udf
from tracklight.operators import frames as fr
from tracklight.operators import jobs, matching, planning, ranges, writers
from tracklight.plans import files  # noqa: F401  (its queries register themselves)
from tracklight.plans.inputs import FRAMES, LIBRARY, QUARTERS, TRACKS, dealt, encoded, flac_bytes, flac_header, frames, library, quarters, sheets, table, total_samples, tracks
from tracklight.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tracklight.sources.frame_index import frames_of
from tracklight.sources.store import per_row
from tracklight.sources.stored import stored


def _line_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("%02d:%02d:%02d", F.col("l_quantity").cast("int"), F.col("l_partkey") % 60, F.col("l_suppkey") % 75).alias("raw"))


_SECTORS = "((l_quantity::bigint * 60 + l_partkey % 60) * 75 + l_suppkey % 75)"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SECTORS} as sectors, {_SECTORS} * 44100 // 75 as s44, {_SECTORS} * 48000 // 75 as s48, {_SECTORS} * 8000 // 75 as s8, ({_SECTORS} * 44100 // 75) * 1000 // 44100 as ms from lineitem")
def cue_time_to_samples(spark, sf):
    t = _line_time(spark, sf).withColumn("t", tm.parse_time(F.col("raw"))).withColumn("sectors", tm.sectors(F.col("t.m"), F.col("t.s"), F.col("t.f")))
    n = F.col("sectors")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sectors", tm.to_samples(n).alias("s44"), tm.to_samples(n, 48_000).alias("s48"), tm.to_samples(n, 8_000).alias("s8"), tm.to_millis(tm.to_samples(n)).alias("ms"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int as m, (l_partkey % 60)::int as s, (l_suppkey % 75)::int as f, {_SECTORS} as sectors from lineitem")
def cue_time_roundtrip(spark, sf):
    t = _line_time(spark, sf).withColumn("t", tm.parse_time(F.col("raw")))
    back = t.withColumn("b", tm.from_sectors(tm.sectors(F.col("t.m"), F.col("t.s"), F.col("t.f"))))
    return back.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.m", "b.s", "b.f", tm.sectors(F.col("b.m"), F.col("b.s"), F.col("b.f")).alias("sectors"))


@query(f"with {TRACKS} select album_id, track_index, start as start_sample, start + len as end_sample, len * 1000 // 44100 as ms from tracks")
def track_ranges(spark, sf):
    return ranges.track_ranges(tracks(spark, sf)).select("album_id", "track_index", "start_sample", "end_sample", ranges.duration_ms(F.col("start_sample"), F.col("end_sample"), 44_100).alias("ms"))


@query(f"with {TRACKS}, t as (select *, total // 2 as cap from tracks) select album_id, track_index, least(start, cap) as start_sample, greatest(least(start, cap), least(coalesce(lead(start) over (partition by album_id order by track_index), cap), cap)) as end_sample from t")
def track_ranges_clamped(spark, sf):
    return ranges.track_ranges(tracks(spark, sf).withColumn("total", F.expr("total div 2"))).select("album_id", "track_index", "start_sample", "end_sample")


@query("select conv_id, turn, length(text)::bigint * 1000 * 1000 // 44100 as ms from conversations")
def range_duration_ms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ranges.duration_ms(F.lit(0), F.length("text").cast("bigint") * 1000, 44_100).alias("ms"))


@query(f"with {FRAMES} select file_id, frame_index, start_sample, sample_count, byte_offset, byte_length from frames")
def frame_prefix_sum(spark, sf):
    return frames(spark, sf)


@query(f"with {FRAMES}, {QUARTERS} select q.file_id, q.lo as sample, b.frame_index, b.byte_offset from quarters q left join bounds b on b.file_id = q.file_id and b.sample = q.lo")
def frame_boundaries(spark, sf):
    f = frames(spark, sf)
    return fr.find_boundary(quarters(f).select("file_id", F.col("lo").alias("sample")), f, "file_id").select("file_id", "sample", "frame_index", "byte_offset")


_SLICE = f"with {FRAMES}, {QUARTERS}"
#: Each quarter with the boundaries at its ends, by one join on the file alone.
_ENDS = f"""{_SLICE}, ends as (select q.file_id, q.q, q.lo, q.hi, max(case when b.sample = q.lo then b.frame_index end) as f0, max(case when b.sample = q.hi then b.frame_index end) as f1,
 max(case when b.sample = q.lo then b.byte_offset end) as b0, max(case when b.sample = q.hi then b.byte_offset end) as b1 from quarters q join bounds b on b.file_id = q.file_id group by q.file_id, q.q, q.lo, q.hi)"""


@query(f"{_ENDS} select file_id, lo, hi, f0 is not null and f1 is not null as aligned, case when f1 is not null then f0 end as first_frame, f1 - f0 as n_frames, case when f1 is not null then b0 end as byte_offset, b1 - b0 as byte_length from ends")
def frame_slice(spark, sf):
    f = frames(spark, sf)
    return fr.slices(quarters(f).select("file_id", "lo", "hi"), f, "file_id")


@query(f"""{_SLICE}, hit as (select q.file_id, q.lo, q.hi, f.frame_index, start_sample as fs, start_sample + sample_count as fe from quarters q join frames f on f.file_id = q.file_id and start_sample < hi and start_sample + sample_count > lo where lo < hi),
g as (select file_id, lo, hi, min(fs) as ffs, arg_min(fe, fs) as ffe, max(fs) as lfs, max(fe) as lfe, min(case when fs >= lo and fe <= hi then frame_index end) as first_mid, count(*) filter (where fs >= lo and fe <= hi) as n_mid from hit group by all)
select file_id, lo, hi, case when ffs < lo or (ffs = lfs and ffe > hi) then least(ffe, hi) end as lead_end, first_mid, n_mid, case when ffs <> lfs and lfe > hi then lfs end as trail_start from g""")
def hybrid_plan(spark, sf):
    f = frames(spark, sf)
    return fr.hybrid_plan(quarters(f).select("file_id", "lo", "hi"), f, "file_id")


@query(f"{_SLICE} select q.file_id, q.lo, count(*) as n from quarters q join frames f on f.file_id = q.file_id and start_sample < hi and start_sample + sample_count > lo group by 1, 2")
def covering_frames(spark, sf):
    f = frames(spark, sf)
    return fr.covering(quarters(f).select("file_id", "lo", "hi"), f, "file_id").groupBy("file_id", "lo").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, case when min(l_quantity) = max(l_quantity) then 'Fixed' else 'Variable' end as mode, min(l_quantity)::bigint * 100 as low, max(l_quantity)::bigint * 100 as high, case when min(l_quantity) = max(l_quantity) then min(l_quantity)::bigint * 100 end as fixed_block from lineitem group by 1")
def preferred_mode(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.min("l_quantity").cast("bigint") * 100).alias("low"), (F.max("l_quantity").cast("bigint") * 100).alias("high"))
    return g.select("l_orderkey", planning.preferred_mode(F.col("low"), F.col("high")).alias("mode"), "low", "high", planning.fixed_block(F.col("low"), F.col("high")).alias("fixed_block"))


@query("select l_orderkey, min(b) filter (where b > 0) as low, max(b) filter (where b > 0) as high, coalesce(sum(b), 0)::bigint as total from (select l_orderkey, case when l_linenumber % 3 = 0 then 0 else l_quantity::bigint end as b from lineitem) group by 1")
def block_stats(spark, sf):
    b = F.when(F.col("l_linenumber") % 3 == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint")
    return planning.block_stats(table(spark, sf, "lineitem").select("l_orderkey", b.alias("b")), "l_orderkey", "b")


@query("select p_partkey, (case c when 0 then null when 1 then 192 when 6 then p_size % 256 + 1 when 7 then p_size * 100 + 1 else case when c <= 5 then 576 * (2 ** (c - 2)) else 256 * (2 ** (c - 8)) end end)::int as samples from (select *, p_partkey % 16 as c from part)")
def block_size_code(spark, sf):
    c = (F.col("p_partkey") % 16).cast("int")
    extra = F.when(c == 6, F.col("p_size") % 256).otherwise(F.col("p_size") * 100)
    return table(spark, sf, "part").select("p_partkey", planning.block_size(c, extra).alias("samples"))


def _planned(spark, sf):
    r = ranges.track_ranges(tracks(spark, sf))
    block = F.lit(4000)
    ok = planning.aligned_heuristic(F.col("start_sample"), block, F.col("total")) & planning.aligned_heuristic(F.col("end_sample"), block, F.col("total"))
    method, rejection = planning.plan(ok, F.col("album_id") % 3 != 0, F.col("album_id") % 5 != 0)
    return r.select("album_id", "track_index", "start_sample", "end_sample", method.alias("method"), rejection.alias("rejection"))


_PLANNED = f"""{TRACKS}, al as (select *, (start = 0 or start = total or start % 4000 = 0) and (start + len = 0 or start + len = total or (start + len) % 4000 = 0) as ok from tracks),
planned as (select album_id, track_index, start as start_sample, start + len as end_sample, case when ok then 'FrameCopy' when album_id % 3 <> 0 and album_id % 5 <> 0 then 'HybridBoundary' when album_id % 5 <> 0 then 'LosslessReencode' else 'FrameCopy' end as method,
case when not ok and album_id % 5 = 0 then 'UnsafeFrameBoundary' end as rejection from al)"""


@query(f"with {_PLANNED} select * from planned")
def split_plan_heuristic(spark, sf):
    return _planned(spark, sf)


@query(f"{_ENDS} select file_id, q, case when f0 is not null and f1 is not null then 'FrameCopy' else 'HybridBoundary' end as method from ends")
def split_plan_indexed(spark, sf):
    f = frames(spark, sf)
    return fr.slices(quarters(f), f, "file_id").select("file_id", "q", planning.plan(F.col("aligned"))[0].alias("method"))


@query(f"""with {_PLANNED}, d as (select *, album_id % 2 = 0 as index_ok, album_id % 7 <> 0 as re from planned),
e as (select *, case when not index_ok and method in ('FrameCopy', 'HybridBoundary') and re then 'LosslessReencode' else method end as m2, case when not index_ok and method in ('FrameCopy', 'HybridBoundary') then case when not re then 'UnsafeFrameBoundary' end else rejection end as r2 from d)
select album_id, track_index, m2 as method, r2 as rejection, case when m2 = 'HybridBoundary' and track_index % 2 = 0 then 'LosslessReencode' else m2 end as made_by from e""")
def plan_demotion(spark, sf):
    m, r = planning.demoted(F.col("method"), F.col("rejection"), F.col("album_id") % 2 == 0, F.col("album_id") % 7 != 0)
    d = _planned(spark, sf).select("album_id", "track_index", m.alias("method"), r.alias("rejection"))
    return d.withColumn("made_by", planning.executed(F.col("method"), F.col("track_index") % 2 != 0))


_HISTOGRAM = f"with {_PLANNED} select method, count(*) as n from planned group by 1"


@query(_HISTOGRAM)
def method_histogram(spark, sf):
    return planning.histogram(_planned(spark, sf))


@query(f"with {_PLANNED} select album_id, count(*) filter (where method = 'FrameCopy' and rejection is null) as frame_copy, count(*) filter (where method = 'HybridBoundary' and rejection is null) as hybrid, count(*) filter (where method = 'LosslessReencode') as reencode from planned group by 1")
def plan_counts(spark, sf):
    return planning.plan_counts(_planned(spark, sf), "album_id")


@query("""with g as (select user_id, count(*) filter (where event_type = 'purchase') as good, count(*) filter (where event_type = 'error') as bad, count(*) filter (where event_type = 'error' and event_id % 3 = 0) as edge, bool_or(event_type = 'signup') as c from events group by 1),
s as (select *, case when c and good = 0 then 'Cancelled' when good > 0 and bad = 0 then 'Succeeded' when good > 0 then 'PartialSuccess' when c then 'Cancelled' else 'Failed' end as state from g)
select user_id, good, bad, state, good || '/' || (good + bad) || ' ok' || case when bad > 0 then ', ' || bad || ' fail' else '' end || case when edge > 0 then ' (' || edge || ' 边界未对齐)' else '' end || ' · Hybrid' as summary,
round(case when state = 'Succeeded' then 1.0::double else 0.08::double + 0.92::double * (good + bad) / greatest(good + bad + 1, 1) end, 6) as progress from s""")
def job_state(spark, sf):
    k = F.col("event_type")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(k == "purchase").alias("good"), F.count_if(k == "error").alias("bad"), F.count_if((k == "error") & (F.col("event_id") % 3 == 0)).alias("edge"), F.max(k == "signup").alias("c"))
    g = g.withColumn("state", jobs.state(F.col("c"), F.col("good"), F.col("bad")))
    done = F.col("good") + F.col("bad")
    return g.select("user_id", "good", "bad", "state", jobs.summary(F.col("good"), F.col("bad"), F.col("edge")).alias("summary"), F.round(jobs.progress(done, done + 1, F.col("state")), 6).alias("progress"))


@query("""with j as (select c_custkey as job_id, case c_custkey % 6 when 0 then 'Running' when 1 then 'Pending' when 2 then 'Failed' when 3 then 'Cancelled' when 4 then 'PartialSuccess' else 'Succeeded' end as was from customer),
s as (select job_id, was, case when job_id % 2 = 0 and was in ('Running', 'Pending') then 'Cancelling' when job_id % 3 = 0 and was in ('Failed', 'Cancelled', 'PartialSuccess') then 'Pending' else was end as state from j)
select job_id, state, case when job_id % 3 = 0 and was in ('Failed', 'Cancelled', 'PartialSuccess') then 0.0::double else 0.5::double end as progress, state in ('Running', 'Pending', 'Cancelling') as active from s""")
def job_transitions(spark, sf):
    """Jobs of all states; even ones are cancelled, then multiples of three are tried again."""
    key = F.col("job_id")
    was = F.element_at(F.array(*map(F.lit, ("Running", "Pending", "Failed", "Cancelled", "PartialSuccess", "Succeeded"))), (key % 6 + 1).cast("int"))
    known = jobs.enqueue(table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))).withColumns({"state": was, "progress": F.lit(0.5)})
    ids = known.select("job_id")
    after = jobs.retry(jobs.cancel(known, ids.where("job_id % 2 = 0")), ids.where("job_id % 3 = 0"))
    return after.select("job_id", "state", "progress", jobs.is_active(F.col("state")).alias("active"))


@query("select event_id, user_id, round(0.08::double + 0.92::double * (count(*) filter (where event_type in ('purchase', 'error')) over (partition by user_id order by ts rows unbounded preceding)) / greatest(100, 1), 6) as progress from events")
def job_progress(spark, sf):
    e = table(spark, sf, "events").withColumn("finished", F.col("event_type").isin("purchase", "error"))
    return jobs.running_done(e, "user_id", "ts").select("event_id", "user_id", F.round(jobs.progress(F.col("done"), F.lit(100)), 6).alias("progress"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc) as r from events) where r = 1")
def job_latest(spark, sf):
    return jobs.latest(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("select o_orderkey, x.k is not null and x.ok as ok, case when x.k is null then 'Unknown' else x.reason end as reason, case when x.k is null then 'missing outcome' else x.message end as message from orders left join (select l_orderkey as k, min(l_quantity) > 5 as ok, min(l_returnflag) as reason, max(l_linestatus) as message from lineitem where l_quantity > 20 group by 1) x on x.k = o_orderkey")
def missing_outcome_fill(spark, sf):
    out = table(spark, sf, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_quantity") > 5).alias("ok"), F.min("l_returnflag").alias("reason"), F.max("l_linestatus").alias("message"))
    return jobs.fill_missing(table(spark, sf, "orders").select("o_orderkey"), out, ["o_orderkey"])


def _shown(m: DataFrame) -> DataFrame:
    return m.withColumn("cues", F.array_join(F.transform("cue_positions", lambda c: c.cast("string")), ",")).drop("cue_positions")


_LISTED = "array_to_string(cs, ',')"


@query(f"with {LIBRARY} select scan_pos, outcome, rule, {_LISTED} as cues from matches where pass = 1")
def match_basename(spark, sf):
    a, c, _ = library(spark, sf)
    return _shown(matching.by_basename(a, c))


@query("""with a as (select p_partkey as scan_pos, p_brand as d, lower(p_name || '-' || p_size) as name from part where p_partkey % 2 = 0),
c as (select p_partkey as cue_pos, p_brand as d, lower(p_name || '-' || (p_size % 7)) as name from part where p_partkey % 2 = 1),
g as (select min(scan_pos) as scan_pos, list(distinct cue_pos order by cue_pos) as cs from a join c using (d, name) group by d, name)
select scan_pos, case when len(cs) = 1 then 'matched' else 'ambiguous' end as outcome, case when len(cs) = 1 then 'CueFileDirective' end as rule, array_to_string(cs, ',') as cues from g""")
def match_file_directive(spark, sf):
    a, c, _ = library(spark, sf)
    return _shown(matching.by_file_entry(a, c))


@query("""with a as (select lower('/m/' || p_brand || '/' || p_size || '/' || p_type) as d, list(p_partkey order by p_partkey) as s from part where p_partkey % 2 = 0 group by 1),
c as (select lower('/m/' || p_brand || '/' || p_size || '/' || p_type) as d, list(p_partkey order by p_partkey) as cs from part where p_partkey % 2 = 1 group by 1)
select d, array_to_string(s, ',') as audio, array_to_string(cs, ',') as cues, case when len(s) = 1 and len(cs) = 1 then 'matched' else 'ambiguous' end as outcome from a join c using (d)""")
def match_unique_pair(spark, sf):
    d = F.concat(F.lit("/m/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), "p_type", F.lit("/"))
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("scan_pos"), d.alias("dir"))
    c = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("cue_pos"), d.alias("cue_dir"))
    got = matching.by_only_pair(a, c)
    return _shown(got.withColumn("audio", F.array_join(F.transform("scan_positions", lambda x: x.cast("string")), ","))).select("d", "audio", "cues", "outcome")


@query(f"with {LIBRARY} select a.scan_pos, case when e.parse_ok then 'matched' else 'unmatched' end as outcome, case when e.parse_ok then 'EmbeddedCue' end as rule, case when e.parse_ok is null then 'No external or embedded CUE' when not e.parse_ok then 'Embedded CUE failed to parse' end as reason from audio a left join embedded e on a.d = e.d and a.name = e.name")
def match_embedded(spark, sf):
    a, _, e = library(spark, sf)
    return matching.by_embedded(a, e)


@query(f"with {LIBRARY} select scan_pos, pass, outcome, rule, reason, {_LISTED} as cues from matches")
def match_cascade(spark, sf):
    return _shown(matching.match(*library(spark, sf)))


@query(f"with {LIBRARY} select outcome, rule, count(*) as n from matches group by 1, 2")
def match_report_counts(spark, sf):
    return matching.report_counts(matching.match(*library(spark, sf)))


@query(f"with {LIBRARY}, pick as (select scan_pos, min(c) as c from (select scan_pos, unnest(cs) as c from matches where outcome = 'ambiguous') group by 1 having scan_pos % 4 = 0) select m.scan_pos, case when p.c is null then outcome else 'matched' end as outcome, case when p.c is null then rule else 'UserConfirmed' end as rule, case when p.c is null then {_LISTED} else p.c::varchar end as cues from matches m left join pick p using (scan_pos)")
def match_confirm(spark, sf):
    m = matching.match(*library(spark, sf))
    decisions = matching.candidates(m).groupBy("scan_pos").agg(F.min("cue_pos").alias("cue_pos")).where("scan_pos % 4 = 0")
    return _shown(matching.confirm(m, decisions)).select("scan_pos", "outcome", "rule", "cues")


@query("select p_partkey as path, p_name || case when p_partkey % 3 = 0 then '.FLAC' else '.wav' end as file_name from part where p_partkey % 3 = 0 and p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def select_flac_gate(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".FLAC").otherwise(".wav")).alias("file_name"))
    return matching.flac_gate(rows, table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("path")))


@query("""with u as (select page_id, url, regexp_extract(url, '([^/\\\\]*)$', 1) as b from pages)
select page_id, case when strpos(substr(b, 2), '.') > 0 then substr(b, 1, length(b) - strpos(reverse(substr(b, 2)), '.')) else b end as base, lower(regexp_replace(url, '[/\\\\]+$', '')) as dir, lower(regexp_replace(regexp_extract(url, '^(.*)[/\\\\]', 1), '[/\\\\]+$', '')) as parent from u""")
def path_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.basename_no_ext(u).alias("base"), T.normalize_dir(u).alias("dir"), T.parent_of(u).alias("parent"))


@query("""with p as (select p_partkey, case p_partkey % 5 when 0 then '.hidden' when 1 then 'Output' when 2 then 'disc 1' when 3 then 'split' else '' end as rel, p_name || (case p_partkey % 7 when 0 then '.FLAC' when 1 then '.wav' when 2 then '.cue' when 3 then '.ape' when 4 then '.txt' when 5 then '.tak' else '.aif' end) as n from part)
select p_partkey, n as name, case p_partkey % 7 when 0 then 'Flac' when 1 then 'Wav' when 3 then 'Ape' when 6 then 'Wav' else 'Other' end as container from p where p_partkey % 5 in (2, 4) and p_partkey % 7 not in (2, 4)""")
def scan_filter(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", pick(5, [".hidden", "Output", "disc 1", "split", ""]).alias("rel"), F.concat("p_name", pick(7, [".FLAC", ".wav", ".cue", ".ape", ".txt", ".tak", ".aif"])).alias("name"))
    return rows.where(((F.col("rel") == "") | T.kept_dir(F.col("rel"))) & ~T.is_sheet(F.col("name")) & T.is_audio(F.col("name"))).select("p_partkey", "name", T.container(F.col("name")).alias("container"))


def _named(spark, sf) -> tuple[DataFrame, dict]:
    c, n = dealt(spark, sf, "customer", "c_custkey"), table(spark, sf, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    v = {"track": F.col("c_custkey") % 150, "title": F.concat("c_name", F.lit(" {artist}")), "artist": F.col("n_name"), "album": F.concat(F.lit("A/"), "c_mktsegment"), "album_artist": F.col("n_name"), "year": F.lit("1999"), "genre": F.lit("Pop: live?"), "disc": F.lit(1)}
    return rows, v


_NAMED = "from customer join nation on c_nationkey = n_nationkey"
_T = "(c_custkey % 150)::varchar"
_NN = f"case when length({_T}) < 2 then '0' || {_T} else {_T} end"


@query(f"select c_custkey, {_NN} || '. ' || c_name || ' ' || n_name || ' - ' || {_T} as rendered {_NAMED}")
def template_render(spark, sf):
    rows, v = _named(spark, sf)
    return rows.select("c_custkey", T.apply_vars(F.lit(" {track:02d}. {Title} - {track} {unknown}"), v).alias("rendered"))


@query(f"select c_custkey, 'A/' || c_mktsegment || '/' || n_name || '/' || {_NN} || '. ' || c_name || ' ' || n_name || ' Pop_ live_.flac' as path {_NAMED}")
def render_relative_path(spark, sf):
    rows, v = _named(spark, sf)
    return rows.select("c_custkey", T.render_path(T.render_directory(F.lit("{album}/./{artist}"), v), T.render_file(F.lit("{track:02d}. {title} {genre}"), v)).alias("path"))


#: White space of Unicode, and the device names that no file may have, as SQL.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_DEVICES = ", ".join(f"'{x}'" for x in T.RESERVED)


@query(f"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^{_SPACE}|{_SPACE}$', '', 'g'), '\\.+$', '') as s from documents)
select doc_id, case when s = '' then '_' when upper(s) in ({_DEVICES}) then '_' || s else s end as segment from s""")
def sanitize_segment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sanitize(F.col("text")).alias("segment"))


@query("select c_custkey, 'TITLE=' || c_name || '|ALBUMARTIST=' || n_name || '|TRACKNUMBER=' || c_custkey || '|MY_KEY=' || c_mktsegment as tags from customer join nation on c_nationkey = n_nationkey")
def vorbis_tags(spark, sf):
    rows, _ = _named(spark, sf)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    pairs = F.array(pair("title", F.col("c_name")), pair("Album Artist", F.col("n_name")), pair("album_artist", F.col("n_name")), pair("tracknr", F.col("c_custkey")), pair("my-key", F.col("c_mktsegment")), pair("blank", F.lit(" ")))
    return rows.select("c_custkey", F.array_join(T.vorbis_tags(pairs), "|").alias("tags"))


@query("""select doc_id, len(regexp_extract_all(text, '(?:"[^"]*"?|[^\\s"])+'))::bigint as n, array_to_string(regexp_extract_all(text, '(?:"[^"]*"?|[^\\s"])+'), '~') as tokens from documents""")
def cue_tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.array_join(t, "~").alias("tokens"))


@query("select c_custkey as path from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0 union all select c_custkey from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def select_toggle(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    return matching.toggled(c.where("path % 2 = 0"), c.where("path % 3 = 0"))


@query(f"with {_PLANNED} select album_id, track_index, 'LosslessReencode' as method, null::varchar as rejection from planned")
def plan_forced_reencode(spark, sf):
    method, rejection = planning.forced_reencode(F.col("method"), F.col("rejection"))
    return _planned(spark, sf).select("album_id", "track_index", method.alias("method"), rejection.alias("rejection"))


@query("select p_partkey, (p_partkey % 11)::int as which, p_name as text from part")
def charset_roundtrip(spark, sf):
    """Names written in each charset by its own name and read back."""
    which = (F.col("p_partkey") % 11).cast("int")
    return table(spark, sf, "part").select("p_partkey", which.alias("which"), _written_and_read(F.col("p_name"), which).alias("text"))


@pandas_udf("string")
def _written_and_read(text, which):
    import pandas as pd

    out = []
    for t, k in zip(text, which, strict=True):
        name, codec = charset.CANDIDATES[int(k)]
        out.append(charset.decode(t.encode(codec), name)[2])
    return pd.Series(out)


def _named_track() -> tuple:
    track = F.struct((F.col("c_custkey") % 150).alias("number"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("performer"))
    album = F.struct(F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 5 != 0, F.col("n_name")).alias("performer"), F.lit("1999").alias("date"), F.lit(" ").alias("genre"))
    return track, album


_ARTIST = "coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, case when c_custkey % 5 <> 0 then n_name end)"
_TITLE = "case when c_custkey % 4 <> 0 then c_name end"


@query(f"select c_custkey, coalesce({_TITLE}, 'Track ' || {_T}) || '|' || coalesce({_ARTIST}, '') || '|' || coalesce(case when c_custkey % 5 <> 0 then n_name end, {_ARTIST}, '') || '|' || c_mktsegment || '|1999|' || {_T} || '|' || lpad({_T}, greatest(3, length({_T}))::int, '0') as rendered {_NAMED}")
def template_context(spark, sf):
    rows, _ = _named(spark, sf)
    v = T.name_context(*_named_track())
    return rows.select("c_custkey", T.apply_vars(F.lit("{title}|{artist}|{album_artist}|{album}|{year}|{track}|{TRACK:03d}"), v).alias("rendered"))


@query(f"select c_custkey, concat_ws('|', 'title=' || {_TITLE}, 'artist=' || {_ARTIST}, 'album=' || c_mktsegment, 'albumartist=' || case when c_custkey % 5 <> 0 then n_name end, 'album_artist=' || case when c_custkey % 5 <> 0 then n_name end, 'track=' || {_T}, 'tracknumber=' || {_T}, 'date=1999') as tags {_NAMED}")
def tag_map(spark, sf):
    rows, _ = _named(spark, sf)
    return rows.select("c_custkey", F.array_join(F.transform(T.tag_pairs(*_named_track()), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "|").alias("tags"))


@query(f"with {TRACKS} select album_id, 'Album ' || album_id as album, '1999' as date, 'a b.flac' as file, (row_number() over (partition by album_id order by track_index) - 1)::int as pos, (track_index % 90 + 1)::int as number, 'Turn ' || track_index as title, (start // 1000) * 44100 // 75 as start_sample from tracks")
def cue_parse_roundtrip(spark, sf):
    p = sheets(spark, sf).select("album_id", cue.parse_cue("text").alias("p"))
    t = p.select("album_id", F.col("p.sheet.title").alias("album"), F.col("p.sheet.date").alias("date"), F.element_at("p.sheet.files", 1)["name"].alias("file"), F.posexplode(cue.all_tracks(F.col("p.sheet"))).alias("pos", "t"))
    ix = tm.start_index(F.col("t.indexes"))
    return t.withColumn("ix", ix).select("album_id", "album", "date", "file", "pos", "t.number", "t.title", tm.to_samples(tm.sectors(F.col("ix.m"), F.col("ix.s"), F.col("ix.f"))).alias("start_sample"))


_BROKEN = ("", 'TITLE "x"', "FILE", "TRACK 99999999999 AUDIO", "TRACK 1 AUDIO\nINDEX 01", "TRACK 1 AUDIO\nINDEX 01 00:60:00", "INDEX 01 bad\nTRACK 1 AUDIO")


@query("select p_partkey, p_partkey % 7 = 6 as ok, case p_partkey % 7 when 0 then 'EmptyInput' when 1 then 'NoTracks' when 5 then 'InvalidTime' when 6 then null else 'InvalidSyntax' end as error, (case when p_partkey % 7 in (2, 3) then 1 when p_partkey % 7 in (4, 5) then 2 end)::int as line_number from part")
def cue_parse_errors(spark, sf):
    text = F.element_at(F.array(*map(F.lit, _BROKEN)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", cue.parse_cue(text).alias("p")).select("p_partkey", "p.ok", "p.error", "p.line_number")


@query("select doc_id, 'UTF-8' as charset_name, 'StrictUtf8' as confidence, substr(replace(text, chr(13) || chr(10), chr(10)), 1, 200) as preview from documents where regexp_full_match(text, '[\\x01-\\x7f]+')")
def charset_ascii(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"^[\x01-\x7f]+\z"))
    return d.select("doc_id", charset.probe_charset(F.encode("text", "UTF-8")).alias("p")).select("doc_id", "p.*")


@query()
def charset_probe(spark, sf):
    return dealt(spark, sf, "documents", "doc_id").select("doc_id", charset.probe_charset(F.encode("text", "UTF-8")).alias("p")).select("doc_id", "p.*")


@query("select p_partkey, (8000 + p_size * 1000)::int as sample_rate, (p_partkey % 8 + 1)::int as channels, (p_partkey % 29 + 4)::int as bits_per_sample, p_partkey * 1000003 as total_samples, p_name as title from part")
def flac_metadata_roundtrip(spark, sf):
    k = F.col("p_partkey")
    made = dealt(spark, sf, "part", "p_partkey").select("p_partkey", flac_header(8000 + F.col("p_size") * 1000, k % 8 + 1, k % 29 + 4, k * 1_000_003, F.concat(F.lit("Title="), "p_name")).alias("data"))
    m = made.select("p_partkey", flac.flac_metadata("data").alias("m"))
    title = F.try_element_at(F.filter("m.comments", lambda c: F.lower(c["k"]) == "title"), F.lit(1))["v"]
    return m.select("p_partkey", "m.info.sample_rate", "m.info.channels", "m.info.bits_per_sample", total_samples(F.col("m.info.total_samples"), F.col("m.comments")).alias("total_samples"), title.alias("title"))


def _files(spark, sf) -> DataFrame:
    blocks = frames(spark, sf).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "sample_count"))), lambda x: x["sample_count"]).alias("b"))
    made = lambda row: iter([{"file_id": row["file_id"], "data": flac_bytes(row["b"])}])
    return per_row(blocks, made, "file_id long, data binary", pa.schema([("file_id", pa.int64()), ("data", pa.binary())]))


@query(f"with {FRAMES} select file_id, frame_index::int as frame_index, start_sample, sample_count::int as sample_count from frames")
def flac_frames_roundtrip(spark, sf):
    return frames_of(_files(spark, sf), ["file_id"]).select("file_id", "frame_index", "start_sample", "sample_count")


@query(f"""{_SLICE}, hit as (select q.file_id, q.q, q.lo, q.hi, min(start_sample) as a, max(start_sample + sample_count) as z, count(*) filter (where start_sample >= lo and start_sample + sample_count <= hi) as n from quarters q join frames f on f.file_id = q.file_id and start_sample < hi and start_sample + sample_count > lo group by 1, 2, 3, 4)
 select file_id, q, case when a = lo and z = hi then 'FrameCopy' when n > 0 then 'HybridBoundary' else 'LosslessReencode' end as method, true as ok, case when n = 0 then 1 else n + (a < lo)::int + (z > hi)::int end as n_frames, hi - lo as samples from hit""")
def track_files(spark, sf):
    """Albums cut into four tracks each, written as whole files and indexed again."""
    files = _files(spark, sf)
    found = stored(frames_of(files, ["file_id"]).drop("error"), "index")
    parts = writers.split(files.withColumnRenamed("data", "content"), found, quarters(frames(spark, sf)), "file_id")
    whole = F.when(F.col("method") == planning.REENCODE, F.col("hi") - F.col("lo"))
    edged = parts.withColumns({"lead": encoded(F.col("lead_end") - F.col("lo")), "trail": encoded(F.col("hi") - F.col("trail_start")), "encoded": encoded(whole)})
    made = frames_of(writers.assemble(edged, ["file_id", "q"]), ["file_id", "q", "method", "ok"])
    return made.groupBy("file_id", "q", "method", "ok").agg(F.count("frame_index").alias("n_frames"), F.sum("sample_count").alias("samples"))


@functools.lru_cache(100_000)
def _round_trip(samples: int, number: int) -> tuple[str, bool, int]:
    """A frame numbered anew and back; files have frames of few sizes at the same places, each of which is made once."""
    old = flac.make_frame(samples, 0, b"body")
    new = flac.renumber(old, number, True)
    head = flac.header_at(new, 0)
    ok = head is not None and flac.crc16(new[:-2]) == int.from_bytes(new[-2:], "big") and flac.renumber(flac.renumber(new, 0, False), 0, False) == old
    return new[4 : 4 + flac.number_length(new[4])].hex(), ok, head[1]


@pandas_udf("struct<back: string, same: boolean, samples: int>")
def _renumbered(number, samples):
    import pandas as pd

    return pd.DataFrame(list(map(_round_trip, samples.tolist(), number.tolist())), columns=["back", "same", "samples"])


@query(f"with {FRAMES} select file_id, frame_index, case when start_sample < 128 then lower(printf('%02x', start_sample)) when start_sample < 2048 then lower(printf('%02x%02x', 192 + start_sample // 64, 128 + start_sample % 64)) when start_sample < 65536 then lower(printf('%02x%02x%02x', 224 + start_sample // 4096, 128 + start_sample // 64 % 64, 128 + start_sample % 64)) else lower(printf('%02x%02x%02x%02x', 240 + start_sample // 262144, 128 + start_sample // 4096 % 64, 128 + start_sample // 64 % 64, 128 + start_sample % 64)) end as back, true as same, sample_count::int as samples from frames")
def renumber_roundtrip(spark, sf):
    return frames(spark, sf).select("file_id", "frame_index", _renumbered("start_sample", "sample_count").alias("r")).select("file_id", "frame_index", "r.*")


def flagship(spark, sf):
    """Sheets parsed, tracks ranged, planned and counted by method."""
    p = sheets(spark, sf).select("album_id", cue.parse_cue("text").alias("p"))
    t = p.select("album_id", F.posexplode(cue.all_tracks(F.col("p.sheet"))).alias("track_index", "t")).withColumn("ix", tm.start_index(F.col("t.indexes")))
    start = tm.to_samples(tm.sectors(F.col("ix.m"), F.col("ix.s"), F.col("ix.f")))
    totals = tracks(spark, sf).groupBy("album_id").agg(tm.to_samples(tm.div(F.max("total"), 1000)).alias("total"))
    r = ranges.track_ranges(t.select("album_id", "track_index", start.alias("start")).join(totals, "album_id"))
    ok = planning.aligned_heuristic(F.col("start_sample"), F.lit(4096), F.col("total")) & planning.aligned_heuristic(F.col("end_sample"), F.lit(4096), F.col("total"))
    return planning.histogram(r.select(planning.plan(ok)[0].alias("method")))
