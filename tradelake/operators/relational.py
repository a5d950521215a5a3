"""Ladders, rollups and ordered operators over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(**sources: Column) -> tuple[Column, Column]:
    """The first value that isn't null, and the name of its source (null if none)."""
    value = F.coalesce(*sources.values())
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in sources.items()))
    return value, name


def best_row(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order that has no ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rank = 1").drop("_rank")


def as_of(rows: DataFrame, starts: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """rows with `value` of the last start at or before them; rows before the first start take the first one's."""
    both = rows.withColumn("_v", F.lit(None).cast(starts.schema[value].dataType)).withColumn("_start", F.lit(0)).unionByName(
        starts.select(by, at, F.col(value).alias("_v")).withColumn("_start", F.lit(1)), allowMissingColumns=True
    )
    ordered = Window.partitionBy(by).orderBy(at, F.desc("_start"), "_v")
    before = F.last("_v", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(before, after)).where("_start = 0").drop("_start", "_v")


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds `island`: the number of the run of equal neighbouring values within its group, from 1."""
    ordered = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(ordered))).cast("int"), F.lit(1))
    new = F.when(F.row_number().over(ordered) == 1, 1).otherwise(new)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def limited(df: DataFrame, by: str, seconds: str, window: int, most: int) -> DataFrame:
    """Adds n (rows of the last `window` seconds, itself included) and retry_after (seconds, null below `most`)."""
    frame = Window.partitionBy(by).orderBy(seconds).rangeBetween(-window + 1, 0)
    counted = df.withColumn("n", F.count("*").over(frame)).withColumn("_oldest", F.min(seconds).over(frame))
    wait = F.greatest(F.lit(1).cast("long"), F.lit(window) - (F.col(seconds) - F.col("_oldest")))
    return counted.withColumn("retry_after", F.when(F.col("n") >= most, wait)).drop("_oldest")
