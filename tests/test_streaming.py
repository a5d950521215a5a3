"""State carried over micro-batches gives the batch operators' rows."""

import random
import time

from pyspark.sql import functions as F

from tradelake.operators.relational import limited
from tradelake.streaming.runs import read_stream, run_available
from tradelake.streaming.stateful import latest, limiter, quota


def test_over_several_batches(spark, tmp_path):
    r = random.Random(2)
    times = sorted(r.randrange(0, 4000) for _ in range(300))
    rows = [(i, r.randrange(4), 1_700_000_000 + t) for i, t in enumerate(times)]
    schema = "event_id long, user_id long, at long"
    every = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    cuts = [t[2] for t in rows[::75]] + [rows[-1][2] + 1]
    for lo, hi in zip(cuts, cuts[1:]):  # whole seconds, so that rows of one second come in one batch
        every.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = lambda: read_stream(spark, str(tmp_path / "in"), 1)
    out = run_available(limiter(stream(), "user_id", "event_id", "ts", 300, 5), "append")
    assert out.select("batch").distinct().count() > 2
    columns = ["event_id", "user_id", "n", "retry_after"]
    want = limited(every, "user_id", "at", 300, 5).select(*columns)
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, want.collect()))
    used = latest(run_available(quota(stream(), "user_id", "ts", "10 minutes", 3), "update"), ["user_id", "start"])
    want = every.groupBy("user_id", F.window("ts", "10 minutes")["start"].alias("start")).agg(F.count("*").alias("used")).withColumn("exceeded", F.col("used") > 3)
    assert sorted(map(str, used.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_late_rows_correct_what_was_said(spark, tmp_path):
    """Files out of time order, a file to a batch, some keys null: the rows of one fold over all."""
    from tradelake.plans.review import learned
    from tradelake.streaming.runs import partial_results, upserted

    r = random.Random(4)
    rows = [(i, r.choice([None, 1, 2, 3]), r.choice(["signup", "view", "view"]), 1_700_000_000 + r.randrange(0, 90 * 86400)) for i in range(240)]
    every = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at long").withColumn("ts", F.timestamp_seconds("at"))
    for k in range(5):
        every.where(F.col("event_id") % 5 == (k * 3) % 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = lambda: read_stream(spark, str(tmp_path / "in"), 1)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(upserted(stream(), ["user_id"], learned), learned(every))
    fold = lambda x: limited(x, "user_id", "at", 86400, 3)
    assert same(upserted(stream(), ["user_id"], fold), fold(every))
    used = lambda x: x.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    assert same(partial_results(stream(), used).groupBy("user_id", "day").agg(F.sum("used").alias("used")), used(every))
