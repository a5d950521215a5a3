"""Stateful operators on streams: sliding limiter, tumbling quota, first of each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def limiter(stream: DataFrame, by: str, row: str, at: str, window: int, most: int) -> DataFrame:
    """row, by, n, retry_after of each row, as the batch operator `limited` gives them.

    A key's state is the times of its last `window` seconds; it goes when the watermark is past them.
    A micro-batch holds a key's times (8 bytes each) in memory, so its size is bounded by files_per_batch.
    Rows that come in a later batch with an earlier time don't change answers already given.
    """
    rows = stream.select(F.col(by).cast("long").alias(by), F.col(row).cast("long").alias(row), F.col(at).cast("timestamp").alias(at))
    rows = rows.withColumn("_at", F.unix_timestamp(at)).withWatermark(at, f"{window} seconds")

    def answer(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = np.array(state.get[0], np.int64) if state.exists else np.zeros(0, np.int64)
        ids, times = [], []
        for part in parts:
            ids.append(part[row].to_numpy())
            times.append(part["_at"].to_numpy())
        ids, times = np.concatenate(ids), np.concatenate(times)
        every = np.sort(np.concatenate([kept, times]))
        first = np.searchsorted(every, times - window + 1, "left")
        n = np.searchsorted(every, times, "right") - first
        wait = np.maximum(1, window - (times - every[first]))
        state.update((every[every > every[-1] - window].tolist(),))
        state.setTimeoutTimestamp(max(int(every[-1]) * 1000 + window * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({row: ids, by: key[0], "n": n, "retry_after": pd.Series(wait, dtype="Int64").mask(n < most)})

    return rows.groupBy(by).applyInPandasWithState(answer, f"{row} long, {by} long, n long, retry_after long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def quota(stream: DataFrame, by: str, at: str, period: str, most: int) -> DataFrame:
    """by, start, used, exceeded: rows of each key in each tumbling period."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", period)
    used = timed.groupBy(by, F.window("_at", period).alias("_w")).agg(F.count("*").alias("used"))
    return used.select(by, F.col("_w.start").alias("start"), "used", (F.col("used") > most).alias("exceeded"))


def latest(output: DataFrame, key: list[str]) -> DataFrame:
    """The last state of each key in the output of a run in update mode."""
    values = [c for c in output.columns if c not in (*key, "batch")]
    return output.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*key, "_v.*")


def first_of_each(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """The keys seen, once each within `delay` of event time: a repeat after it counts as new."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(key).select(*key)
