"""File systems as workers open them: any that pyarrow knows by its URI."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

_URI = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*)://")


def absolute(root: str) -> str:
    """A root as all workers understand it."""
    return root if _URI.match(root) else os.path.abspath(root)


def prefix(root: str) -> str:
    """What a path of this root's file system begins with when it is shown: nothing for local files, else the scheme."""
    m = _URI.match(root)
    return "" if m is None or m[1] == "file" else m[0]


@functools.lru_cache(64)
def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    return fs.FileSystem.from_uri(root)


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Small rows that each stand for much reading, dealt to as many tasks as a shuffle has (and no more than `most`): by the rows'
    own size they would be put together in one."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(n, most or n)), *keys)


def rows_of(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[dict]:
    """A batch's rows, as many converted at once as make about so many bytes."""
    step = max(1, b.num_rows * size // max(1, b.nbytes))
    for lo in range(0, b.num_rows, step):
        yield from b.slice(lo, step).to_pylist()


def batched(rows: Iterator[dict], fields: pa.Schema, most: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """rows in batches of at most so many rows and, by the binary columns, about so many bytes."""
    blobs, held, weight = [f.name for f in fields if pa.types.is_binary(f.type)], [], 0
    for out in rows:
        held.append(out)
        weight += sum(len(out[c] or b"") for c in blobs)
        if len(held) >= most or weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema=fields)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=fields)


def per_row(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str, fields: pa.Schema, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """What make yields for each row of df, in batches of at most so many rows and, by the binary columns, about so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for b in batches for row in rows_of(b) for out in make(row)), fields, rows, size)

    return df.mapInArrow(run, schema)
