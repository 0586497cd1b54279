"""The queries on keys and rows that larger tables have."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklight.functions import flac
from tracklight.operators import writers
from tracklight.plans import catalogue
from tracklight.sources import walk
from tracklight.sources.frame_index import frames_of
from tracklight.sources.store import batched, rows_of

SF = "/root/testdata/sf0.001"


def moved(spark, tmp_path, changes):
    """The smallest tables with some replaced: {name: function of the table}."""
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        if name in changes:
            changes[name](spark.read.parquet(f"{SF}/{f}")).write.parquet(f"{tmp_path}/{f}")
        else:
            os.symlink(f"{SF}/{f}", f"{tmp_path}/{f}")
    return str(tmp_path)


def compared(spark, sf, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'") if os.path.isdir(f"{sf}/{t}.parquet") else c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    cols = got.columns
    return sorted(tuple(r) for r in got.collect()), sorted(c.execute(f"select {', '.join(cols)} from ({catalogue.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["flac_metadata_roundtrip", "library_heads"])
def test_totals_beyond_36_bits(spark, tmp_path, name):
    sf = moved(spark, tmp_path, {"part": lambda p: p.limit(40).withColumn("p_partkey", F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 7_000_000).otherwise(68_700))})
    got, want = compared(spark, sf, name, ["part"])
    assert got == want and len(got) == 40


def test_segments_of_device_names_and_unicode_spaces(spark, tmp_path):
    """Device names get an underscore and any white space goes, in the SQL as in the query."""
    texts = ["con", "Aux.", " lpt9 ", "COM0", "com1 x", "\u00a0nul\u3000", "\u2028", "a\u0085", "...", "", "a:b. .", None, "x\n", 'q\\"?']
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = moved(spark, tmp_path, {"documents": lambda d: spark.createDataFrame(rows, d.schema)})
    got, want = compared(spark, sf, "sanitize_segment", ["documents"])
    assert got == want
    assert dict(got) == dict(enumerate(["_con", "_Aux", "_lpt9", "COM0", "com1 x", "_nul", "_", "a", "_", "_", "a_b. ", None, "x_", "q___"]))


def test_frames_of_many_files_equal_the_serial_ones(spark):
    """Damaged, cut, fixed-size and empty files among whole ones, some with false headers in their bodies."""
    rng = random.Random(5)
    info = {"min_block": 100, "max_block": 100, "min_frame": 0, "max_frame": 0, "sample_rate": 44_100, "channels": 2, "bits_per_sample": 16}
    files = [None, b"", b"fLaC", flac.container(info | {"total_samples": 0}, [])]
    for i in range(300):
        sizes = [rng.choice((1, 100, 4096, 60_000)) for _ in range(rng.randrange(1, 9))]
        bodies = [rng.choice((rng.randbytes(rng.randrange(300)), flac.make_frame(7, 3, b"")[:9] * 2, b"\xff\xf8")) for _ in sizes]
        audio = b"".join(flac.make_frame(n, rng.choice((k, 70_000 + k)), x, i % 2 == 1) for k, (n, x) in enumerate(zip(sizes, bodies)))
        fixed = rng.choice((0, 0, len(audio)))
        data = bytearray(flac.container(info | {"min_frame": fixed, "max_frame": fixed, "total_samples": sum(sizes) + (i % 11 == 3)}, ["A=b"], audio))
        if i % 7 == 2:
            data[rng.randrange(len(data))] ^= 1
        files.append(bytes(data[: len(data) - (i % 13 == 4)]))
    df = spark.createDataFrame(list(enumerate(files)), "k long, data binary")
    plain = lambda d: sorted(map(repr, d.select("k", "frame_index", "start_sample", "sample_count", "byte_offset", "byte_length", "error").collect()))
    got = plain(frames_of(df.repartition(2), ["k"]))
    assert got == plain(df.lateralJoin(flac.flac_frames(F.col("data").outer()))) and len(got) > 700


def test_batches_of_rows_and_files_are_bounded_by_bytes():
    """A task that makes large files holds a few of them at once."""
    fields = pa.schema([("data", pa.binary())])
    got = [b.num_rows for b in batched(({"data": bytes(1 << 20)} for _ in range(40)), fields)]
    assert sum(got) == 40 and max(got) <= 16
    b = pa.RecordBatch.from_pylist([{"data": bytes(400_000)}] * 9, schema=fields)
    assert list(rows_of(b)) == b.to_pylist()


def test_renumbered_checksums_by_the_whole_frame():
    for n, size in ((1, 0), (300, 1), (5000, 2), (9, 4095), (70, 4097), (77, 20_000)):
        old = flac.make_frame(n, 3, os.urandom(size))
        new = flac.renumber(old, 123_456, True)
        assert flac.crc16(new) == 0 and flac.header_at(new, 0)[1] == n and flac.renumber(new, 3, False) == old


def test_audio_is_never_broadcast(spark):
    """Contents look small by their listing; a plan that brings them to the driver fails on larger libraries."""
    files = spark.createDataFrame([(1, b"x")], "k long, content binary")
    frames = spark.createDataFrame([(1, 0, 0, 10, 0, 5)], "k long, frame_index int, start_sample long, sample_count int, byte_offset long, byte_length int")
    plan = writers.split(files, frames, spark.createDataFrame([(1, 0, 10)], "k long, lo long, hi long"), "k")._jdf.queryExecution().sparkPlan().toString()
    line = next(x for x in plan.splitlines() if "Join" in x)
    assert "SortMergeJoin" in line


def test_local_folders_are_listed_as_they_are_read(tmp_path, monkeypatch):
    """No list of a flat folder's files is made."""
    for i in range(50):
        (tmp_path / f"{i}.wav").write_bytes(b"x" * i)
    monkeypatch.setattr("tracklight.sources.walk.fs.FileSelector", None)
    rows = list(walk._listed({"store": f"file://{tmp_path}", "at": None, "root": 0, "key": [], "rel": ""}))
    assert sorted((r["at"], r["size_bytes"], r["kind"]) for r in rows) == sorted((f"{tmp_path}/{i}.wav", i, "file") for i in range(50))
