"""What the text operators share: input normalisation, durable intermediate tables, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
word_list = re.compile(WORD).findall

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors and keep Arrow batches small in rows and in bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tracklight_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables.  Only a session of one machine (tests) gets a temporary one
    where none is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Intermediate tables that are still there, each with a weak reference to the file listing that all plans over it share.
_tables: dict[str, object] = {}
#: Seconds between looks for tables that no plan reads any more, and the last look.
SWEEP = 15
_swept = time.monotonic()


def _remove(spark: SparkSession, path: str) -> None:
    if path not in _tables:
        return
    del _tables[path]
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return  # the session has ended; the folder's owner cleans up
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of the jobs within go as soon as each has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing but
    its running tasks.  The table goes with release(), after no DataFrame reads it any more, or when the driver ends."""
    spark = df.sparkSession
    if time.monotonic() - _swept > SWEEP:
        sweep(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    listing = out._jdf.queryExecution().analyzed().relation().location()
    _tables[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(listing)
    atexit.register(functools.partial(_remove, spark, path))
    return out


def release(*tables: DataFrame) -> None:
    """Drop materialised tables that no DataFrame reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.stored_at)


def sweep(spark: SparkSession) -> None:
    """Drop the materialised tables that no DataFrame reads any more, whatever was made from them: those whose listing the JVM has
    collected.  A session holds the plans of its last actions a little longer."""
    global _swept
    _swept = time.monotonic()
    if _tables:
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        for path, listing in list(_tables.items()):
            if listing.get() is None:
                _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, null_as: str | None = "") -> DataFrame:
    """doc_id and text only, whatever other columns there are; null texts become null_as."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text if null_as is None else F.coalesce(text, F.lit(null_as))).alias("text"))
