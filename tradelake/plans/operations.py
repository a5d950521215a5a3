"""Queries of the operational views: listings, rollups, quotas, limiters and claims."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.relational import best_row, limited
from ..sources.tables import ITEMS_SQL, items, read


def _jobs_page(s, d):
    page = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day")).orderBy(F.desc("day"), F.desc("o_orderkey"))
    return page.offset(100).limit(50)  # the page is what is asked for


def _usage(s, d):
    e = read(s, d, "events").withColumn("op", F.when(F.col("event_type") == "view", "ocr").otherwise("extraction"))
    cost = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long"))
    return e.withColumn("cost", cost).groupBy("user_id", "op").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost_cents"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def _quota(s, d):
    e = read(s, d, "events").where("event_type = 'view'").withColumn("day", F.to_date("ts"))
    n = e.groupBy("user_id", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("used"))
    return n.select("user_id", "month", "used", (F.col("used") > 15).alias("exceeded"))


def _pivot(s, d):
    return read(s, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).select("o_custkey", *(F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"))


def _known(s, d):
    keys = read(s, d, "customer").select(F.col("c_custkey").alias("owner")).union(read(s, d, "orders").select("o_custkey")).union(read(s, d, "events").select("user_id"))
    return keys.where("owner is not null").distinct()


def _latest(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


def _limiter(s, d):
    e = read(s, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr("unix_timestamp(cast(ts as timestamp))").alias("at"))
    return limited(e, "user_id", "at", 86400, 3).select("event_id", "user_id", "n", "retry_after")


def _digest(s, d):
    x = read(s, d, "documents").withColumn("digest", F.sha2(F.col("text"), 256))
    return best_row(x, ["digest"], [F.col("doc_id")]).select("digest", "doc_id", "source")


def _claim(s, d):
    e = read(s, d, "events").withColumn("job", F.col("event_id") % 100)
    return best_row(e, ["job"], [F.col("ts"), F.col("event_id")]).select("job", F.col("user_id").alias("worker"))


def _grouped(s, d):
    x = items(s, d).where("l_returnflag = 'R'")
    return x.groupBy("l_orderkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("ord")), 1, 20), ",").alias("items"), F.count("*").alias("n"))


def _overlay(s, d):
    """Later edits win over printed values, removed items go, the rest are numbered anew."""
    gone = items(s, d).where("l_linestatus = 'F' and ord % 3 = 0").select("l_orderkey", "ord")
    edits = items(s, d).where("l_returnflag = 'A'").select("l_orderkey", "ord", (F.col("cents") + 100).alias("edited"))
    x = items(s, d).select("l_orderkey", "ord", "cents").join(gone, ["l_orderkey", "ord"], "left_anti").join(edits, ["l_orderkey", "ord"], "left")
    return x.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ord")).alias("place"), F.coalesce("edited", "cents").alias("cents"))


def _accounts(s, d):
    n = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"))
    return n.orderBy(F.desc("documents"), "o_custkey").limit(200)  # the page is what is asked for


QUERIES = {
    "jobs_page": (_jobs_page, "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS day FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 50 OFFSET 100"),
    "accounts_page": (_accounts, "SELECT o_custkey, count(*) AS documents FROM orders GROUP BY 1 ORDER BY documents DESC, o_custkey LIMIT 200"),
    "usage_summary": (_usage, "SELECT user_id, CASE WHEN event_type = 'view' THEN 'ocr' ELSE 'extraction' END AS op, count(*) AS calls, sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END)::BIGINT AS cost_cents, count(*) FILTER (WHERE event_type = 'error') AS unpriced FROM events GROUP BY 1, 2"),
    "quota_month": (_quota, "SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*) AS used, count(*) > 15 AS exceeded FROM events WHERE event_type = 'view' GROUP BY 1, 2"),
    "status_pivot_map": (_pivot, "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1"),
    "known_keys_union": (_known, "SELECT c_custkey AS owner FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events"),
    "latest_actor": (_latest, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "limiter_day": (_limiter, """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_ FROM events WHERE event_type = 'error'), w AS (SELECT *, count(*) OVER f AS n, min(at_) OVER f AS oldest FROM e WINDOW f AS (PARTITION BY user_id ORDER BY at_ RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, n, CASE WHEN n >= 3 THEN greatest(1, 86400 - (at_ - oldest)) END AS retry_after FROM w"""),
    "dedupe_digest": (_digest, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "claim_first_wins": (_claim, "SELECT job, worker FROM (SELECT event_id % 100 AS job, user_id AS worker, row_number() OVER (PARTITION BY event_id % 100 ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"),
    "messages_grouped": (_grouped, f"WITH {ITEMS_SQL} SELECT l_orderkey, array_to_string(list(ord ORDER BY ord)[1:20], ',') AS items, count(*) AS n FROM items WHERE l_returnflag = 'R' GROUP BY 1"),
    "overlay_replay": (_overlay, f"WITH {ITEMS_SQL} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS place, CASE WHEN l_returnflag = 'A' THEN cents + 100 ELSE cents END AS cents FROM items WHERE NOT (l_linestatus = 'F' AND ord % 3 = 0)"),
}
