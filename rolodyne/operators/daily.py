"""Engagement figures kept up to date by days instead of over all history.

Every batch of new events leaves one small row for each contact, channel and day:
counts, first and last instants, the latest message. Such rows add up, so a
figure as of an instant is a merge of days, and a further batch only reads what
it brings. Days that the window cuts are counted from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activity as A

DAY_ROW = "contact_id, channel, day"


def day_partials(events: DataFrame, keywords: list[str] | None = None, **hours) -> DataFrame:
    """Usable events -> one row for each contact, channel and UTC day."""
    at, way = F.col("ts"), F.col("direction")
    hits = A.keyword_hits(F.col("body"), keywords) if keywords else F.lit(0)
    rows = A.usable(events).select("contact_id", "channel", F.to_date("ts").alias("day"), "ts", "event_id", "direction", A.business_hours(at, **hours).cast("int").alias("open"), hits.alias("hits"))
    return rows.groupBy("contact_id", "channel", "day").agg(
        F.count_if(way == "inbound").alias("n_in"),
        F.count_if(way == "outbound").alias("n_out"),
        F.sum("open").alias("open"),
        F.sum("hits").alias("hits"),
        F.min(at).alias("first_seen"),
        F.max(F.when(way == "inbound", at)).alias("last_in"),
        F.max(F.when(way == "outbound", at)).alias("last_out"),
        F.max(F.struct("ts", "event_id", "direction")).alias("latest"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Rows of several batches for a day as one."""
    sums = [F.sum(c).alias(c) for c in ("n_in", "n_out", "open", "hits")]
    return partials.groupBy("contact_id", "channel", "day").agg(*sums, F.min("first_seen").alias("first_seen"), *(F.max(c).alias(c) for c in ("last_in", "last_out", "latest")))


def add_batch(new: DataFrame, path: str, batch: str, keywords: list[str] | None = None, **hours) -> None:
    """Writes a batch's rows beside the earlier ones, by month. The events have to
    be new (see ingest); a batch that runs again replaces its own rows."""
    rows = day_partials(new, keywords, **hours).withColumn("ym", F.date_format("day", "yyyy-MM"))
    rows.write.mode("overwrite").partitionBy("ym").parquet(f"{path}/batch={batch}")


def read_days(spark, path: str, since: str | None = None) -> DataFrame:
    """The kept rows, from a month (yyyy-MM) on if only those are needed."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.where(F.col("ym") >= since) if since else rows


def compact(spark, path: str, target: str) -> None:
    """The kept rows merged to one a day, as a single batch elsewhere."""
    merged(read_days(spark, path)).withColumn("ym", F.date_format("day", "yyyy-MM")).write.mode("overwrite").partitionBy("ym").parquet(f"{target}/batch=merged")


def window_figures(days: DataFrame, events: DataFrame | None, as_of: str, windows: tuple[int, ...] = A.DAYS, keywords: list[str] | None = None, **hours) -> DataFrame:
    """What activity.window_kpis gives, from kept days. As of an instant within a
    day, each window cuts two days: those are counted from `events`, of which only
    these days are read."""
    whole = A.instant(as_of) == F.date_trunc("day", A.instant(as_of))
    pieces = None
    for d in windows:
        start, end = A.before(as_of, d), A.instant(as_of)
        full = days.where((F.col("day").cast("timestamp") >= start) & (F.date_add("day", 1).cast("timestamp") <= end))
        parts = full.select("contact_id", "channel", "n_in", "n_out", "open", "hits", "last_in", "last_out")
        if events is not None:
            at = F.col("ts")
            cut = (F.to_date(at) == F.to_date(start)) & (F.date_trunc("day", start) < start) | (F.to_date(at) == F.to_date(end)) & ~whole
            edge = events.where((at >= start) & (at < end) & cut)
            parts = parts.unionByName(day_partials(edge, keywords, **hours).select(*parts.columns))
        one = parts.withColumn("window_days", F.lit(d))
        pieces = one if pieces is None else pieces.unionByName(one)
    n = F.sum("n_in") + F.sum("n_out")
    return pieces.groupBy("contact_id", "window_days").agg(
        F.sum("n_in").alias("messages_in"),
        F.sum("n_out").alias("messages_out"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.max("last_in").alias("last_inbound"),
        F.max("last_out").alias("last_outbound"),
        F.round(F.sum("open") / n, 2).alias("business_ratio"),
        F.sum("hits").alias("keyword_hits"),
    )


def history_figures(days: DataFrame) -> DataFrame:
    """First and last instants of all history and whose turn it is."""
    latest = F.max("latest")
    out = days.groupBy("contact_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_in").alias("last_inbound_ever"), F.max("last_out").alias("last_outbound_ever"), latest.alias("latest"))
    return out.withColumn("awaiting_side", F.when(F.col("latest.direction") == "inbound", "mine").otherwise("theirs")).drop("latest")


def main_channel(days: DataFrame, as_of: str, since_days: int = 90) -> DataFrame:
    """Most used channel of whole days since as_of - since_days; ties to the first name."""
    counts = days.where(F.col("day") >= F.to_date(A.before(as_of, since_days))).groupBy("contact_id", "channel").agg(F.sum(F.col("n_in") + F.col("n_out")).alias("n"))
    return counts.groupBy("contact_id").agg(F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("channel_primary"), F.max("n").alias("channel_messages"))
