"""The library's inputs (events, contacts, change logs) as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

AS_OF, DAYS, TODAY = "2024-01-31 00:00:00", (3, 10, 30), "2001-09-01"


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Message events: inbound are signups, purchases and errors; a thread is a
    user's bucket of props.k."""
    e = table(spark, sf, "events")
    bucket = F.get_json_object("props", "$.k").cast("int") % 4
    return e.select("event_id", F.col("user_id").alias("contact_id"), "ts", F.when(F.col("event_type").isin("signup", "purchase", "error"), "inbound").otherwise("outbound").alias("direction"), F.col("event_type").alias("channel"), F.concat_ws("-", "user_id", bucket).alias("thread_id"), F.lit("").alias("body"), "value")


#: The same view for DuckDB.
INTERACTIONS = """i AS (SELECT event_id, user_id AS contact_id, ts, CASE WHEN event_type IN ('signup','purchase','error') THEN 'inbound' ELSE 'outbound' END AS direction,
 event_type AS channel, concat(user_id, '-', CAST(json_extract_string(props, '$.k') AS INT) % 4) AS thread_id, value FROM events)"""


def order_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer the last order's day and up to two interactions kinds."""
    o = table(spark, sf, "orders")
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("last_date"), F.countDistinct(F.col("o_orderstatus")).alias("interactions"), F.count(F.lit(1)).alias("orders"))
    return per


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a change log: a customer's change of a field by day."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("resource_name"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("reason"), F.col("o_orderstatus").alias("field"), (F.col("o_totalprice") / 500000).alias("confidence"))


def event_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of one field: each event's type is the new value, the
    one before it the old value of that user and bucket."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("resource_name"), (F.get_json_object("props", "$.k").cast("int") % 20).alias("field"), F.col("event_id").alias("seq"), F.col("event_type").alias("new"))
    w = Window.partitionBy("resource_name", "field").orderBy("seq")
    return rows.withColumn("old", F.coalesce(F.lag("new").over(w), F.lit("view")))


EVENT_CHANGES = """c AS (SELECT *, coalesce(lag(new) OVER (PARTITION BY resource_name, field ORDER BY seq), 'view') AS old FROM
 (SELECT user_id AS resource_name, CAST(json_extract_string(props, '$.k') AS INT) % 20 AS field, event_id AS seq, event_type AS new FROM events))"""
