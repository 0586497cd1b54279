"""Exact ranks without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = "_part"


def gapless_rank(rows: DataFrame, order: list[str | Column], within: list[str] | None = None, name: str = "rank", stored: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """rows with `name`, 0, 1, 2, … in `order` among the rows that share the columns of `within` (without nulls; none: all rows).

    The rows are sorted by range, and `stored` cuts the lineage there, so that counts and ranks are of the same ranges; a rank is
    the place in a range plus the counts of earlier ranges.  A group may hold any share of the rows: it spreads over as many
    ranges as its size asks for.  Rows equal in within and order share a range, in any order; no rows give no rows.  Bounds are
    found in a pass of its own: store what is costly to compute before.
    """
    within = within or []
    placed = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(placed).withColumn(_PART, F.shiftright("_at", 33))
    counts = ranged.groupBy(*within, _PART).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row for each range and group: as few as ranges and groups together.
    earlier = Window.partitionBy(*within).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*within, _PART, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    keys = [*within, _PART]
    return ranged.join(base, keys).select(*rows.columns, (F.col("_base") + F.col("_at") - F.col("_first")).cast("long").alias(name))
