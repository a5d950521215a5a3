"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step points neighbours at the least node they know of; a step is one aggregation and one join
over the links, nothing is gathered, and the links shrink to one for each node. The steps' tables are
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: u, v with u > v, distinct."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:  # neighbours above u point at the least of all
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and the neighbours below it point at the least of them
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable), for each id that stands in a link. links: a, b (long); nulls and loops are ignored."""
    pairs = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.written(pairs)
    state = None
    while True:
        pairs = scratch.written(_star(scratch.written(_star(pairs, True)), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    found = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
