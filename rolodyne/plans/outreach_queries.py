"""Outreach, status and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outreach as O
from ..operators import status as H
from ..session import table
from .views import AS_OF


def outreach_stats(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    contacts = e.select(F.element_at(kinds, F.col("event_type")).alias("status"))
    runs = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("sent"))
    snaps = O.with_delta(runs.select(F.lit("a").alias("account"), F.col("day").alias("at"), F.col("sent").alias("followers")))
    return O.outreach_stats(contacts, runs, snaps)


_STATUS = {"view": "PENDING", "click": "CONNECTED", "signup": "RESPONDED", "purchase": "DM_SENT", "error": "DM_SKIPPED"}
OUTREACH_STATS = """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM d), s AS (SELECT arg_max(n, day) AS followers, CAST(sum(delta) AS BIGINT) AS follower_delta FROM l),
c AS (SELECT count(*) AS contacts, count(*) FILTER (event_type = 'click') AS connected, count(*) FILTER (event_type = 'view') AS pending, 0::BIGINT AS creator_mode, count(*) FILTER (event_type = 'purchase') AS dm_sent, count(*) FILTER (event_type = 'error') AS dm_skipped, count(*) FILTER (event_type = 'signup') AS responded, count(*) AS sent FROM events)
SELECT *, round(100 * round(sent * 0.88::DOUBLE) / sent) AS acceptance_percent FROM c, s"""


def message_stats(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    return O.message_stats(e.select(F.element_at(kinds, F.col("event_type")).alias("status"), F.date_add(F.to_date("ts"), 7).alias("follow_up")), AS_OF[:10])


MESSAGE_STATS = f"""SELECT count(*) FILTER (event_type IN ('purchase', 'signup')) AS sent, count(*) FILTER (event_type = 'error') AS skipped, round(100.0 * count(*) FILTER (event_type = 'signup') / count(*) FILTER (event_type IN ('purchase', 'signup')), 0)::DOUBLE AS answered_percent,
count(*) FILTER (event_type = 'purchase' AND CAST(ts AS DATE) + 7 <= DATE '{AS_OF[:10]}') AS due FROM events"""


def harvest_status(spark, sf):
    e = table(spark, sf, "events")
    runs = e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("mode"), F.lit(1).alias("chats"), F.col("event_id").alias("records_new"), F.when(F.col("event_type") == "error", "auth_error").otherwise("ok").alias("upload_status"), F.array().cast("array<string>").alias("errors"))
    return H.harvest_status(runs, AS_OF).select("mode", "records_new", "runs_7d", "errors_7d", "hours_since", "staleness")


HARVEST_STATUS = f"""WITH l AS (SELECT * FROM events ORDER BY ts DESC LIMIT 1)
SELECT l.event_type AS mode, l.event_id AS records_new, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS runs_7d, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND event_type = 'error') AS errors_7d,
round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(l.ts)) / 3600000000.0::DOUBLE, 1) AS hours_since, CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(l.ts)) / 3600000000.0 < 12 THEN 'fresh' WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(l.ts)) / 3600000000.0 < 48 THEN 'hours' ELSE 'days' END AS staleness FROM l"""


def select_targets(spark, sf):
    c = table(spark, sf, "customer")
    ids = c.select(F.col("c_custkey").alias("resource_name"), F.col("c_acctbal").alias("score"), "c_nationkey")
    scans = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("resource_name")).agg(F.max("o_orderdate").alias("scanned_at"))
    return O.select_targets(ids.where("score > 9000"), ids.where("c_nationkey = 7"), scans, "2001-08-02", 30, 60).withColumn("source", F.col("source").cast("long"))


SELECT_TARGETS = """WITH r AS (SELECT c_custkey AS resource_name, CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END AS source, CASE WHEN c_acctbal > 9000 THEN c_acctbal ELSE 0 END AS s FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 7),
f AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-02') < 30)
SELECT resource_name, source::BIGINT AS source FROM r WHERE resource_name NOT IN (SELECT o_custkey FROM f) ORDER BY source, s DESC, resource_name LIMIT 60"""


def changed_notes(spark, sf):
    o = table(spark, sf, "orders")
    day = lambda c: F.to_date(c)
    now = o.groupBy(F.col("o_custkey").alias("resource_name")).agg(day(F.max("o_orderdate")).alias("email_date"), day(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("meeting_date"))
    before = o.where("o_orderdate < '2001-01-01'").groupBy(F.col("o_custkey").alias("resource_name")).agg(day(F.max("o_orderdate")).alias("email_date"), day(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("meeting_date"))
    return O.changed_notes(now, before).select("resource_name", F.col("email_date").cast("string").alias("email_date"))


CHANGED_NOTES = """WITH n AS (SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS e, CAST(max(o_orderdate) FILTER (o_orderstatus = 'F') AS DATE) AS m FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS e, CAST(max(o_orderdate) FILTER (o_orderstatus = 'F') AS DATE) AS m FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT n.k AS resource_name, strftime(n.e, '%Y-%m-%d') AS email_date FROM n LEFT JOIN b USING (k) WHERE b.k IS NULL OR n.e IS DISTINCT FROM b.e OR n.m IS DISTINCT FROM b.m"""


def queue_by_category(spark, sf):
    from .audit_queries import REASONS

    e = table(spark, sf, "events").where("value > 20")
    reason = F.element_at(F.array(*(F.lit(r) for r in REASONS)), (F.col("event_id") % len(REASONS) + 1).cast("int"))
    q = H.queue_stats(e.select(reason.alias("reason")), "2024-01-31")
    return q.select("date", F.explode("by_category").alias("category", "n"))


def _queue_sql() -> str:
    from .audit_queries import REASONS, _category_sql

    return f"WITH r AS (SELECT ([{', '.join(repr(x) for x in REASONS)}])[CAST(event_id % {len(REASONS)} + 1 AS INT)] AS reason FROM events WHERE value > 20) SELECT '2024-01-31' AS date, {_category_sql('reason')} AS category, count(*) AS n FROM r GROUP BY ALL"


QUERIES = {
    "outreach_stats": (outreach_stats, OUTREACH_STATS),
    "message_stats": (message_stats, MESSAGE_STATS),
    "harvest_status": (harvest_status, HARVEST_STATUS),
    "select_targets": (select_targets, SELECT_TARGETS),
    "changed_notes": (changed_notes, CHANGED_NOTES),
    "queue_by_category": (queue_by_category, _queue_sql()),
}
