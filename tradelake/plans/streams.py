"""Queries of the streaming operators, run over all events available; the rows equal those of the batch forms, whatever the order of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.relational import limited
from ..streaming.runs import partial_results, read_stream, upserted
from .operations import QUERIES as BATCH
from .review import QUERIES as REVIEW, layouts, learned


def _events(s, d):
    return read_stream(s, f"{d}/events.parquet")


def _limiter(s, d):
    """Each user's answers are folded anew when a batch brings rows of theirs, late ones too."""
    errors = _events(s, d).where("event_type = 'error'").select("user_id", "event_id", F.unix_timestamp("ts").alias("seconds"))
    return upserted(errors, ["user_id"], lambda rows: limited(rows, "user_id", "seconds", 86400, 3)).select("event_id", "user_id", "n", "retry_after")


def _quota(s, d):
    """Uses of a day are counted by batch and added up."""
    def counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))

    used = partial_results(_events(s, d).where("event_type = 'view'"), counts).groupBy("user_id", "day").agg(F.sum("used").alias("used"))
    return used.withColumn("exceeded", F.col("used") > 2)


def _dedupe(s, d):
    keys = ["user_id", "event_type", "day"]
    return partial_results(_events(s, d).withColumn("day", F.to_date("ts")), lambda rows: rows.select(*keys).distinct()).distinct()


def _profiles(s, d):
    """Vendors' profiles as shipments come in, the batch fold's rows."""
    return upserted(_events(s, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], learned)


def _layout_memory(s, d):
    """Remembered layouts as documents come in; a signature's row is folded anew when a batch brings one of its documents."""
    rows = _events(s, d).select(F.col("event_type").alias("role"), (F.col("event_id") % 12).alias("signature"), F.expr("cast(value as bigint)").alias("confirmed"), "user_id", "ts", "event_id")
    return layouts(upserted(rows, ["role", "signature"], lambda x: layouts(x, placed=False)), placed=True)


QUERIES = {
    "stream_limiter": (_limiter, BATCH["limiter_day"][1]),
    "stream_quota": (_quota, "SELECT user_id, ts::DATE AS day, count(*) AS used, count(*) > 2 AS exceeded FROM events WHERE event_type = 'view' GROUP BY 1, 2"),
    "stream_dedupe": (_dedupe, "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events"),
    "stream_profiles": (_profiles, REVIEW["profile_fold"][1]),
    "stream_layouts": (_layout_memory, REVIEW["layout_memory"][1]),
}
