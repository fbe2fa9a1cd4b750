"""Run logs, health and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .activity import instant, staleness
from .audit import rule_category
from .scoring import score_stats


def harvest_summary(records: DataFrame, new: DataFrame) -> DataFrame:
    """Per channel and month: seen, new, matched, unmatched."""
    month = F.date_format("timestamp", "yyyy-MM").alias("month")
    seen = records.groupBy("channel", month).agg(F.count(F.lit(1)).alias("seen"))
    fresh = new.groupBy("channel", month).agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("contactId").isNotNull()).alias("matched"), F.count_if(F.col("contactId").isNull()).alias("unmatched"))
    return seen.join(fresh, ["channel", "month"], "left").fillna(0, ["new", "matched", "unmatched"])


def harvest_status(runs: DataFrame, as_of: str) -> DataFrame:
    """runs (timestamp, mode, chats, records_new, upload_status, errors array): the
    last one, how stale it is, runs and failed runs of the last seven days."""
    week = F.col("timestamp") >= instant(as_of) - F.expr("INTERVAL 7 DAYS")
    failed = F.col("upload_status").isin("auth_error", "transient_error") | (F.size("errors") > 0)
    s = runs.agg(F.max_by(F.struct("timestamp", "mode", "chats", "records_new", "upload_status"), "timestamp").alias("last"), F.count_if(week).alias("runs_7d"), F.count_if(week & F.coalesce(failed, F.lit(False))).alias("errors_7d"))
    age = (F.unix_micros(instant(as_of)) - F.unix_micros("last.timestamp")) / F.lit(3_600_000_000)
    return s.select("last.*", "runs_7d", "errors_7d", F.round(age, 1).alias("hours_since"), staleness(F.col("last.timestamp"), as_of).alias("staleness"))


def run_status(log: DataFrame, session: str | None, started: str | None = None, completed: str | None = None) -> DataFrame:
    """Applied and failed of the session's batches (all without a session), and its seconds."""
    ends = log.where("type = 'batch_end'")
    ends = ends.where(F.col("session_id") == session) if session else ends
    seconds = F.unix_timestamp(instant(completed)) - F.unix_timestamp(instant(started)) if started and completed else F.lit(None).cast("long")
    return ends.agg(F.coalesce(F.sum("success"), F.lit(0)).alias("applied"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed")).withColumn("seconds", seconds)


def run_cost(runs: DataFrame) -> DataFrame:
    """runs (date, phases map<string, double>): the costs of a run's phases; null if none."""
    cost = F.aggregate(F.map_values("phases"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return runs.select("date", F.when(cost > 0, F.round(cost, 3)).alias("cost"))


def token_cost(calls: DataFrame, per_million_in: float, per_million_out: float, cap: float = 1.0) -> DataFrame:
    """calls (tokens_in, tokens_out): their cost, and whether the cap is exceeded."""
    cost = (F.coalesce(F.sum("tokens_in"), F.lit(0)) * per_million_in + F.coalesce(F.sum("tokens_out"), F.lit(0)) * per_million_out) / F.lit(1e6)
    return calls.agg(F.count(F.lit(1)).alias("calls"), cost.alias("cost")).withColumn("exceeded", F.col("cost") >= cap)


def queue_stats(pending: DataFrame, day: str) -> DataFrame:
    """Waiting changes by category, as one row of the queue's log."""
    by = pending.groupBy(rule_category(F.col("reason")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.lit(day).alias("date"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("by_category"))


def health(runs: DataFrame, queue: DataFrame, signals: DataFrame, scores: DataFrame) -> DataFrame:
    """The last run, the queue's last state, and how many signals and candidates there are."""
    r = runs.agg(F.max_by(F.struct("date", "duration_seconds", "changes_applied", "changes_failed"), "date").alias("r"), F.count(F.lit(1)).alias("total_runs")).select("r.*", "total_runs")
    q = queue.agg(F.coalesce(F.max_by("total", "date"), F.lit(0)).alias("pending_changes"), F.max("date").alias("queue_date"), F.count(F.lit(1)).alias("queue_history"))
    return r.crossJoin(q).crossJoin(signals.agg(F.count(F.lit(1)).alias("signals"))).crossJoin(scores.agg(F.count(F.lit(1)).alias("candidates")))  # one row each


def score_file(scored: DataFrame, generated: str) -> DataFrame:
    """All scores with their stats as one JSON document a row of stats and one a score."""
    stats = score_stats(scored).select(F.lit(0).alias("line"), F.to_json(F.struct(F.lit(generated).alias("generated"), F.struct("*").alias("stats"))).alias("value"))
    rows = scored.select(F.col("rank").alias("line"), F.to_json(F.struct(*(c for c in scored.columns))).alias("value"))
    return stats.unionByName(rows)


def digest(scored: DataFrame, n: int = 3) -> DataFrame:
    """The first n scores and how many there are."""
    top = scored.orderBy("rank").limit(n).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "score_total"))).alias("top"))
    return top.crossJoin(scored.agg(F.count(F.lit(1)).alias("total")))  # one row each
