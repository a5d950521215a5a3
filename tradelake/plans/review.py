"""Queries of page windows, merged evidence, overlays and review: pages are conversation turns, jobs are orders or users, edits are events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.relational import best_row
from ..sources.tables import ITEMS_SQL, items, read


def _ids(s, d):
    """A stable id for each item: its lineage and its number among equal lineages, hashed."""
    lineage = F.concat_ws("|", F.col("l_orderkey").cast("string"), (F.col("l_partkey") % 7).cast("string"), F.col("l_returnflag"))
    x = items(s, d).withColumn("lineage", lineage)
    occurrence = F.row_number().over(Window.partitionBy("l_orderkey", "lineage").orderBy("ord")) - 1
    return x.select("l_orderkey", "ord", F.substring(F.sha1(F.concat_ws("#", "lineage", occurrence.cast("string"))), 1, 16).alias("item_id"))


def _overrides(s, d):
    """What a reviewer changed: only keys whose value differs from the default, with both."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    x = read(s, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), cents, F.lit("buyer"), F.col("o_custkey").cast("string")).alias("default"), F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("status"), F.lit("F"), F.lit("note"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("buyer"), (F.col("o_custkey") % 50).cast("string"))).alias("given"))
    both = F.map_zip_with("given", "default", lambda k, to, old: F.when(to.isNotNull() & ~to.eqNullSafe(old), F.concat_ws(" -> ", F.coalesce(old, F.lit("-")), to)))
    changed = F.map_filter(both, lambda k, v: v.isNotNull())
    return x.select("o_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries(changed)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ").alias("changes"))


def _next_index(s, d):
    """The place a job's next upload of a role would take."""
    return read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("next_index"))


def _goods(s, d):
    """Goods of real invoices: pro-forma and charge documents go, unless nothing else is left; rows without any value go with a note."""
    x = items(s, d).withColumn("real", F.col("l_returnflag") == "N").withColumn("valued", (F.col("ord") % 6 != 0))
    keep = F.col("real") | ~F.max("real").over(Window.partitionBy("l_orderkey"))
    x = x.withColumn("keep", keep)
    return x.groupBy("l_orderkey").agg(F.count_if(F.col("keep") & F.col("valued")).alias("goods"), F.count_if(F.col("keep") & ~F.col("valued")).alias("skipped"), F.count_if(~F.col("keep")).alias("excluded"), F.sum(F.when(F.col("keep") & F.col("valued"), F.col("cents"))).alias("cents"))


def _line_value(s, d):
    """A line's value: the printed total, else quantity by price to the cent; zero where the price isn't is told."""
    x = items(s, d).withColumn("printed", F.when(F.col("ord") % 3 == 0, F.col("cents")).when(F.col("ord") % 5 == 0, 0)).withColumn("mils", F.expr("cents * 10 div cast(l_quantity as bigint)"))
    made = F.expr("(cast(l_quantity as bigint) * mils + 5) div 10")
    code = F.when(F.col("printed").isNull(), "COMPUTED").when((F.col("printed") == 0) & (F.col("mils") > 0), "ZERO_SUSPECT").otherwise("PRINTED")
    return x.select("l_orderkey", "ord", F.coalesce("printed", made).cast("long").alias("value"), code.alias("code"))


def _visible(s, d):
    """Jobs each buyer sees: their own, and those of the system's (buyer 0)."""
    own = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    who = read(s, d, "customer").select("c_custkey")
    mine = who.join(own, F.col("c_custkey") == F.col("owner")).groupBy("c_custkey").agg(F.count("*").alias("own_jobs"))
    system = own.where("owner = 0").agg(F.count("*").alias("system_jobs"))  # one row
    x = who.join(mine, "c_custkey", "left").crossJoin(F.broadcast(system))
    return x.select("c_custkey", (F.coalesce("own_jobs", F.lit(0)) + F.when(F.col("c_custkey") == 0, 0).otherwise(F.col("system_jobs"))).alias("visible"))


def _messages(s, d):
    """Messages of one code and item once, at their first place."""
    x = read(s, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("code"), F.expr("cast(value as bigint) % 3").alias("text"), "event_id")
    return best_row(x, ["item", "code", "text"], [F.col("event_id")]).select("item", "code", "text", F.col("event_id").alias("place"))


def _permutation(s, d):
    """Whether an overlay's order names each active item once."""
    x = items(s, d).withColumn("active", ~((F.col("l_linestatus") == "F") & (F.col("ord") % 4 == 0))).withColumn("named", F.when((F.col("l_orderkey") % 5 == 0) & (F.col("ord") == 2), 1).otherwise(F.col("ord")))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("active"), F.col("ord")))).alias("have"), F.array_sort(F.collect_list(F.when(F.col("active"), F.col("named")))).alias("want"))
    return g.select("l_orderkey", (F.col("have") == F.col("want")).alias("valid"))


def _confirmed(s, d):
    """A reviewer's confirmation over the defaults: none keeps them, a blank one is a blank on purpose; reviewed totals are the authority."""
    k = F.col("o_orderkey") % 4
    given = F.when(k == 1, "").when(k == 2, F.concat(F.lit("  "), F.lower("o_orderpriority"))).when(k == 3, F.lit(None))
    total = F.round(F.col("o_totalprice") * 100).cast("long")
    return read(s, d, "orders").select("o_orderkey", F.when(given.isNull(), F.col("o_orderpriority")).otherwise(F.trim(given)).alias("priority"), F.coalesce(F.when(k == 2, F.lit(12345).cast("long")), total).alias("total"), F.when(k == 2, "REVIEWER").otherwise("DOCUMENT").alias("source"))


def _reset(s, d):
    """Edits that outlive new evidence: those of the last evidence version (a signup begins one); codes chosen before stay as history, the last of each name."""
    e = read(s, d, "events")
    version = F.count_if(F.col("event_type") == "signup").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("version", version).withColumn("last", F.max("version").over(Window.partitionBy("user_id"))).where("event_type in ('click', 'purchase')")
    live = e.groupBy("user_id").agg(F.count_if(F.col("version") == F.col("last")).alias("live"), F.count_if(F.col("version") < F.col("last")).alias("discarded"))
    history = e.where("version < last and event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("history"))
    return live.join(history, "user_id", "left")


def _latest_artefact(s, d):
    x = read(s, d, "events").where("event_type = 'purchase'")
    return best_row(x, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


def _trail(s, d):
    """A job's events in order of time, numbered."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(s, d, "events").select("event_id", "user_id", place.alias("place"))


def _page_windows(s, d, size: int = 2):
    """Runs of neighbouring pages with something to read (120 characters or more), cut in windows of `size`, each with a page of context on either side."""
    pages = read(s, d, "conversations").where("role = 'user' and char_length(text) >= 120").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = pages.withColumn("run", F.col("turn") - 2 * F.row_number().over(w))  # a user's turns are two apart
    x = x.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn")) - 1) / size))
    g = x.groupBy("conv_id", "run", "part").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))
    return g.select("conv_id", "first", "last", "n", F.greatest(F.lit(0).cast("long"), F.col("first") - 1).alias("context_from"), (F.col("last") + 1).alias("context_to"))


def _header_zone(s, d, around: int = 2, margin: int = 1):
    """Turns kept of a long page: the head and tail, and those around a hit."""
    x = read(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.col("text").rlike("(?i)code|license|number"), F.lit(False)).alias("hit"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    near = F.max("hit").over(w.rowsBetween(-around, around))
    place, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("conv_id"))
    return x.select("conv_id", "turn", "role", (near | (place <= margin) | (place > n - margin)).alias("kept"))


def _merged(s, d):
    """Headers of a document's chunks merged: of each field the first chunk's that has it; rows counted, in page order."""
    x = items(s, d).withColumn("currency", F.when(F.col("l_returnflag") == "A", F.col("l_linestatus"))).withColumn("number", F.when(F.col("ord") > 1, F.col("l_partkey")))
    first = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.col("ord"))).alias(v)
    return x.groupBy("l_orderkey").agg(first("currency"), first("number"), F.count("*").alias("rows"))


def _scope(s, d):
    """Rows that fall outside the pages they were asked for, with how many of them each job drops."""
    asked = read(s, d, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day")).distinct()
    x = read(s, d, "events").where("event_type = 'click'").select("event_id", "user_id", F.to_date("ts").alias("day"))
    kept = x.join(asked, ["user_id", "day"], "left_semi").groupBy("user_id").agg(F.count("*").alias("kept"))
    dropped = x.join(asked, ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("dropped"))
    return kept.join(dropped, "user_id", "full").select("user_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def _spans(s, d):
    """Pages of each sub-invoice: from its first to the one before the next one's; the last goes to the end."""
    x = items(s, d).groupBy("l_orderkey", "l_returnflag").agg(F.min("ord").alias("first"))
    n = items(s, d).groupBy("l_orderkey").agg(F.count("*").cast("int").alias("pages"))
    after = F.lead("first").over(Window.partitionBy("l_orderkey").orderBy("first"))
    return x.join(n, "l_orderkey").select("l_orderkey", "l_returnflag", "first", F.coalesce(after - 1, "pages").cast("int").alias("last"))


def _fingerprint(s, d):
    """A digest of a job's review that changes if any item does, whatever their order in storage."""
    x = items(s, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", "l_partkey", "cents"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["ord"].cast("string"), r["l_partkey"].cast("string"), r["cents"].cast("string"))), ";")
    return x.select("l_orderkey", F.sha2(text, 256).alias("fingerprint"))


def learned(events, agreed: int = 2):
    """A vendor's country as its shipments teach it, in order of time: a reviewer's word stands over observations and an observation
    that contradicts the last one begins anew; it is proposed on a reviewer's word, or after `agreed` like observations.

    By windows, so that a vendor's history is sorted and spilled, not held: the last reviewer's row, else the last run of equal values.
    """
    by = Window.partitionBy("user_id")
    ordered = by.orderBy("ts", "event_id")
    x = events.select("user_id", "ts", "event_id", (F.col("event_id") % 3).alias("value"), (F.col("event_type") == "signup").alias("reviewer"))
    x = x.withColumn("i", F.row_number().over(ordered)).withColumn("fresh", F.coalesce(F.lag("value").over(ordered) != F.col("value"), F.lit(True)))
    g = x.groupBy("user_id").agg(
        F.max_by("value", F.when(F.col("reviewer"), F.col("i"))).alias("said"), F.coalesce(F.bool_or("reviewer"), F.lit(False)).alias("reviewer"),
        F.max_by("value", "i").alias("last"), (F.max("i") - F.max(F.when(F.col("fresh"), F.col("i"))) + 1).alias("n"),
    )
    value = F.when(F.col("reviewer"), F.col("said")).otherwise(F.col("last"))
    return g.select("user_id", value.alias("value"), "reviewer", F.when(F.col("reviewer") | (F.col("n") >= agreed), value).alias("proposed"))


def _profile(s, d):
    return learned(read(s, d, "events"))


def layouts(rows, placed: bool = True):
    """Remembered layouts: the most confirmed rows, documents seen and the first vendor of each signature; the most confirmed first.

    rows: documents (role, signature, confirmed, user_id, ts, event_id), or results without places.
    """
    g = rows if "docs" in rows.columns else rows.groupBy("role", "signature").agg(F.max("confirmed").alias("confirmed"), F.count("*").alias("docs"), F.min_by("user_id", F.struct("ts", "event_id")).alias("vendor"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("confirmed"), F.desc("docs"), "signature"))) if placed else g


def _layouts(s, d):
    return layouts(read(s, d, "events").select(F.col("event_type").alias("role"), (F.col("event_id") % 12).alias("signature"), F.expr("cast(value as bigint)").alias("confirmed"), "user_id", "ts", "event_id"))


def _regime(s, d):
    """Selections patched in turn: of each key the last version's value that was given."""
    x = read(s, d, "events").select("user_id", F.col("event_type").alias("key"), F.when(F.col("event_id") % 4 > 0, F.col("event_id")).alias("value"), "ts", "event_id")
    return x.groupBy("user_id", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("value"))


def _over_count(s, d):
    """Pages on which more rows were captured than goods lines are printed, and pages that print goods of which none was captured."""
    printed = items(s, d).groupBy("l_orderkey", "l_linestatus").agg(F.count_if(F.col("l_quantity") > 5).alias("anchors"))
    rows = items(s, d).where("l_returnflag <> 'A'").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("rows"))
    x = printed.join(rows, ["l_orderkey", "l_linestatus"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    code = F.when((F.col("anchors") > 0) & (F.col("rows") == 0), "INCOMPLETE").when(F.col("rows") > F.col("anchors"), "OVER_COUNT").otherwise("OK")
    return x.select("l_orderkey", "l_linestatus", "anchors", "rows", code.alias("code"))


def _truncated(s, d):
    """Pages whose table is narrower than others of the same heading and whose goods rows (3 or more) lack values in 60 % of cases."""
    x = items(s, d).withColumn("width", F.when(F.col("l_linestatus") == "F", 9 - F.col("l_orderkey") % 2).otherwise(9)).withColumn("bare", F.col("l_tax") < 0.05)
    g = x.groupBy("l_orderkey", "l_linestatus").agg(F.max("width").alias("width"), F.count("*").alias("n"), F.count_if("bare").alias("bare"))
    widest = F.max("width").over(Window.partitionBy("l_orderkey"))
    return g.select("l_orderkey", "l_linestatus", ((F.col("width") < widest) & (F.col("n") >= 3) & (F.col("bare") * 10 >= F.col("n") * 6)).alias("truncated"))


_E = "CAST(round(o_totalprice * 100) AS BIGINT)"
QUERIES = {
    "source_item_ids": (_ids, f"""WITH {ITEMS_SQL}, x AS (SELECT *, l_orderkey || '|' || (l_partkey % 7) || '|' || l_returnflag AS lineage FROM items)
SELECT l_orderkey, ord, substr(sha1(lineage || '#' || (row_number() OVER (PARTITION BY l_orderkey, lineage ORDER BY ord) - 1)), 1, 16) AS item_id FROM x"""),
    "override_diff": (_overrides, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat_ws('; ', 'note: - -> ' || o_orderpriority, CASE WHEN o_orderstatus <> 'F' THEN 'status: ' || o_orderstatus || ' -> F' END) WHEN o_custkey % 50 <> o_custkey THEN 'buyer: ' || o_custkey || ' -> ' || (o_custkey % 50) ELSE '' END AS changes FROM orders"""),
    "next_upload_index": (_next_index, "SELECT user_id, event_type, count(*) AS next_index FROM events GROUP BY 1, 2"),
    "goods_filter_fallback": (_goods, f"""WITH {ITEMS_SQL}, x AS (SELECT *, l_returnflag = 'N' OR NOT bool_or(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS keep, ord % 6 <> 0 AS valued FROM items)
SELECT l_orderkey, count(*) FILTER (WHERE keep AND valued) AS goods, count(*) FILTER (WHERE keep AND NOT valued) AS skipped, count(*) FILTER (WHERE NOT keep) AS excluded, sum(cents) FILTER (WHERE keep AND valued)::BIGINT AS cents FROM x GROUP BY 1"""),
    "line_value_rule": (_line_value, f"""WITH {ITEMS_SQL}, x AS (SELECT *, l_quantity::BIGINT AS q, cents * 10 // l_quantity::BIGINT AS mils FROM items)
SELECT l_orderkey, ord, CASE WHEN ord % 3 = 0 THEN cents WHEN ord % 5 = 0 THEN 0 ELSE (q * mils + 5) // 10 END AS value, CASE WHEN ord % 3 = 0 THEN 'PRINTED' WHEN ord % 5 = 0 THEN 'ZERO_SUSPECT' ELSE 'COMPUTED' END AS code FROM x"""),
    "tenant_visibility": (_visible, """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0) + CASE WHEN c_custkey = 0 THEN 0 ELSE coalesce((SELECT n FROM o WHERE o_custkey = 0), 0) END AS visible FROM customer LEFT JOIN o ON o_custkey = c_custkey"""),
    "message_dedup": (_messages, "SELECT user_id AS item, event_type AS code, CAST(floor(value) AS BIGINT) % 3 AS text, min(event_id) AS place FROM events GROUP BY 1, 2, 3"),
    "permutation_invariant": (_permutation, f"""WITH {ITEMS_SQL}, x AS (SELECT * FROM items WHERE NOT (l_linestatus = 'F' AND ord % 4 = 0)), g AS (SELECT l_orderkey, max(CASE WHEN l_orderkey % 5 = 0 AND ord = 2 THEN 1 ELSE 0 END) AS bad FROM x GROUP BY 1)
SELECT o.l_orderkey, coalesce(bad, 0) = 0 AS valid FROM (SELECT DISTINCT l_orderkey FROM items) o LEFT JOIN g USING (l_orderkey)"""),
    "confirmation_merge": (_confirmed, f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 4 = 2 THEN 12345 ELSE {_E} END AS total, CASE WHEN o_orderkey % 4 = 2 THEN 'REVIEWER' ELSE 'DOCUMENT' END AS source FROM orders"""),
    "evidence_reset": (_reset, """WITH v AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events), l AS (SELECT *, max(version) OVER (PARTITION BY user_id) AS last FROM v)
SELECT user_id, count(*) FILTER (WHERE version = last) AS live, count(*) FILTER (WHERE version < last) AS discarded, arg_max(event_id, {'t': ts, 'e': event_id}) FILTER (WHERE version < last AND event_type = 'purchase') AS history FROM l WHERE event_type IN ('click', 'purchase') GROUP BY 1"""),
    "latest_artefact": (_latest_artefact, "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "audit_trail": (_trail, "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events"),
    "page_windows": (_page_windows, """WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) >= 120), n AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM 2 AS fresh FROM p),
r AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n), k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1) // 2 AS part FROM r)
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n, greatest(0, min(turn) - 1) AS context_from, max(turn) + 1 AS context_to FROM k GROUP BY conv_id, run, part"""),
    "header_zone": (_header_zone, """WITH x AS (SELECT conv_id, turn, role, coalesce(regexp_matches(text, '(?i)code|license|number'), false) AS hit, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT x.conv_id, x.turn, x.role, x.place = 1 OR x.place = x.n OR EXISTS (SELECT 1 FROM x y WHERE y.conv_id = x.conv_id AND y.hit AND abs(y.place - x.place) <= 2) AS kept FROM x"""),
    "chunk_merge": (_merged, f"""WITH {ITEMS_SQL} SELECT l_orderkey, arg_min(l_linestatus, ord) FILTER (WHERE l_returnflag = 'A') AS currency, arg_min(l_partkey, ord) FILTER (WHERE ord > 1) AS number, count(*) AS rows FROM items GROUP BY 1"""),
    "scope_filter": (_scope, """WITH a AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'view'), x AS (SELECT e.user_id, a.day IS NOT NULL AS inside FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.day = e.ts::DATE WHERE event_type = 'click')
SELECT user_id, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS dropped FROM x GROUP BY 1"""),
    "roster_spans": (_spans, f"""WITH {ITEMS_SQL}, f AS (SELECT l_orderkey, l_returnflag, min(ord) AS first FROM items GROUP BY ALL), n AS (SELECT l_orderkey, count(*) AS pages FROM items GROUP BY 1)
SELECT l_orderkey, l_returnflag, first, coalesce(lead(first) OVER (PARTITION BY l_orderkey ORDER BY first) - 1, pages)::INTEGER AS last FROM f JOIN n USING (l_orderkey)"""),
    "review_fingerprint": (_fingerprint, f"WITH {ITEMS_SQL} SELECT l_orderkey, sha256(string_agg(ord || ':' || l_partkey || ':' || cents, ';' ORDER BY ord)) AS fingerprint FROM items GROUP BY 1"),
    "profile_fold": (_profile, """WITH e AS (SELECT user_id, event_id % 3 AS value, event_type = 'signup' AS reviewer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, max(i) FILTER (WHERE reviewer) AS word FROM e GROUP BY 1), k AS (SELECT e.*, lag(value) OVER (PARTITION BY user_id ORDER BY i) IS DISTINCT FROM value AS fresh FROM e), g AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY i) AS run FROM k),
l AS (SELECT user_id, arg_max(value, i) AS value, arg_max(run, i) AS run FROM g GROUP BY 1), n AS (SELECT user_id, run, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id, CASE WHEN word IS NULL THEN l.value ELSE e.value END AS value, word IS NOT NULL AS reviewer, CASE WHEN word IS NOT NULL THEN e.value WHEN n.n >= 2 THEN l.value END AS proposed FROM r JOIN l USING (user_id) JOIN n USING (user_id, run) LEFT JOIN e ON e.user_id = r.user_id AND e.i = word"""),
    "layout_memory": (_layouts, """WITH g AS (SELECT event_type AS role, event_id % 12 AS signature, max(CAST(floor(value) AS BIGINT)) AS confirmed, count(*) AS docs, arg_min(user_id, {'t': ts, 'e': event_id}) AS vendor FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY role ORDER BY confirmed DESC, docs DESC, signature) AS place FROM g"""),
    "regime_selections": (_regime, "SELECT user_id, event_type AS key, arg_max(event_id, {'t': ts, 'e': event_id}) FILTER (WHERE event_id % 4 > 0) AS value FROM events GROUP BY 1, 2"),
    "page_row_counts": (_over_count, """WITH x AS (SELECT l_orderkey, l_linestatus, count(*) FILTER (WHERE l_quantity > 5) AS anchors, count(*) FILTER (WHERE l_returnflag <> 'A') AS rows FROM lineitem GROUP BY 1, 2)
SELECT *, CASE WHEN anchors > 0 AND rows = 0 THEN 'INCOMPLETE' WHEN rows > anchors THEN 'OVER_COUNT' ELSE 'OK' END AS code FROM x"""),
    "truncated_columns": (_truncated, """WITH g AS (SELECT l_orderkey, l_linestatus, CASE WHEN l_linestatus = 'F' THEN 9 - l_orderkey % 2 ELSE 9 END AS width, count(*) AS n, count(*) FILTER (WHERE l_tax < 0.05) AS bare FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linestatus, width < max(width) OVER (PARTITION BY l_orderkey) AND n >= 3 AND bare * 10 >= n * 6 AS truncated FROM g"""),
}
