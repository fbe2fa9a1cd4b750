"""Ingestion queries on events, in batches and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.rules import phone
from ..session import table
from ..shared import shared_dir
from ..streaming import ingest as I


def incremental_ingest(spark, sf):
    """Two slices that overlap by five minutes give the whole, each id once."""
    e = table(spark, sf, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    early, late = e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut - F.expr(f"INTERVAL {I.OVERLAP}"))
    whole = I.ingest_slices([early, late])
    return whole.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


INCREMENTAL_INGEST = "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL"


def stream_kpi(spark, sf):
    """Events as a stream, every seventh of them twice, deduplicated, written by
    month, then counted."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = I.read_stream(spark, sf, schema, pathGlobFilter="events.parquet")
    events = events.unionByName(events.where("event_id % 7 = 0"))
    query = I.run_ingest(I.deduplicated(events), f"{run}/out", f"{run}/state")
    query.awaitTermination()
    done = spark.read.parquet(f"{run}/out")
    return done.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


STREAM_KPI = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"


def phone_rules(spark, sf):
    c = table(spark, sf, "customer")
    n = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+4219"), F.right(n, F.lit(8)))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("00420 6"), F.right(n, F.lit(8)))).otherwise(F.concat(F.lit("09"), F.right(n, F.lit(8))))
    p = c.select("c_custkey", phone(raw).alias("p"))
    return p.select("c_custkey", "p.formatted", "p.e164", "p.kind")


PHONE_RULES = """WITH n AS (SELECT c_custkey, right(lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0'), 8) AS t FROM customer), e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN '4206' ELSE '4219' END || t AS d FROM n)
SELECT c_custkey, concat('+', d[1:3], ' ', d[4:6], ' ', d[7:9], ' ', d[10:12]) AS formatted, '+' || d AS e164, 'mobile' AS kind FROM e"""

QUERIES = {
    "incremental_ingest": (incremental_ingest, INCREMENTAL_INGEST),
    "stream_kpi": (stream_kpi, STREAM_KPI),
    "phone_rules": (phone_rules, PHONE_RULES),
}
