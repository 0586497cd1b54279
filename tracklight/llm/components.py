"""Connected components of a link table, by alternating stars, without gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import materialise


def _largest(both: DataFrame) -> DataFrame:
    """Each node's larger neighbours now hang on its smallest neighbour (or itself)."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smallest(down: DataFrame) -> DataFrame:
    """Each node with its smaller neighbours now hangs on the smallest of these.  down: rows u > v."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in links(u long, v long).

    Large-star and small-star rounds alternate until the links no longer change; each round is a written table.  Rows that
    repeat, loops and either direction are fine; nodes without a link to another are absent; no links give an empty result.
    """
    down = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _largest(both)
        down = materialise(_smallest(large), "stars")
        now = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
