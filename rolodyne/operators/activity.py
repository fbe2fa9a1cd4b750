"""Engagement indicators from message events.

Events have contact_id, event_id, ts, direction (inbound or outbound), channel,
thread_id and optionally body. `as_of` is always a parameter. All indicators of
a contact come from one aggregation by contact; response pairs from one window
by thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_hits

DAYS = (30, 90, 365)
#: Business words counted in messages.
KEYWORDS = ["meeting", "demo", "price", "pricing", "proposal", "quote", "invoice", "contract", "payment", "deal", "kickoff", "timeline", "scope", "sow", "rfp", "po", "offer", "agreement"]
#: Points of the engagement bonus and the thresholds they hang on.
BONUS = {"awaiting": 15.0, "multichannel": 10.0, "keywords": 20.0, "hours": 5.0, "hours_ratio": 0.7, "inbound_heavy": 8.0, "inbound_delta": 5, "stale": -10.0, "stale_count": 3, "silence": -15.0, "silence_days": 180, "low": -20.0, "high": 40.0}


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def before(as_of: str, days: int) -> Column:
    return instant(as_of) - F.make_interval(days=F.lit(days))


def usable(events: DataFrame) -> DataFrame:
    return events.where(F.col("direction").isin("inbound", "outbound") & F.col("ts").isNotNull() & (F.coalesce("channel", F.lit("")) != ""))


def business_hours(ts: Column, zone: str = "Europe/Bratislava", start: int = 9, end: int = 18) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return (F.weekday(local) < 5) & (F.hour(local) >= start) & (F.hour(local) < end)


def window_kpis(events: DataFrame, as_of: str, days: tuple[int, ...] = DAYS, keywords: list[str] | None = None, **hours) -> DataFrame:
    """One row per contact and trailing window [as_of - days, as_of)."""
    at = F.col("ts")
    open_ = business_hours(at, **hours)
    hits = keyword_hits(F.col("body"), keywords) if keywords else F.lit(0)
    rows = usable(events).where((at >= before(as_of, max(days))) & (at < instant(as_of)))
    rows = rows.select("contact_id", "ts", "direction", "channel", open_.cast("int").alias("open"), hits.alias("hits"))
    aggs = []
    for d in days:
        inside = at >= before(as_of, d)
        inbound, outbound = inside & (F.col("direction") == "inbound"), inside & (F.col("direction") == "outbound")
        aggs += [
            F.count_if(inbound).alias(f"in_{d}"),
            F.count_if(outbound).alias(f"out_{d}"),
            F.array_sort(F.collect_set(F.when(inside, F.col("channel")))).alias(f"channels_{d}"),
            F.max(F.when(inbound, at)).alias(f"last_in_{d}"),
            F.max(F.when(outbound, at)).alias(f"last_out_{d}"),
            F.sum(F.when(inside, F.col("open"))).alias(f"open_{d}"),
            F.sum(F.when(inside, F.col("hits"))).alias(f"hits_{d}"),
        ]
    wide = rows.groupBy("contact_id").agg(*aggs)
    each = F.array(*(F.struct(F.lit(d).alias("window_days"), *(F.col(f"{c}_{d}").alias(c) for c in ("in", "out", "channels", "last_in", "last_out", "open", "hits"))) for d in days))
    long = wide.select("contact_id", F.explode(each).alias("w")).select("contact_id", "w.*").where(F.col("in") + F.col("out") > 0)
    return long.select(
        "contact_id",
        "window_days",
        F.col("in").alias("messages_in"),
        F.col("out").alias("messages_out"),
        "channels",
        F.col("last_in").alias("last_inbound"),
        F.col("last_out").alias("last_outbound"),
        F.round(F.col("open") / (F.col("in") + F.col("out")), 2).alias("business_ratio"),
        F.col("hits").alias("keyword_hits"),
    )


def kpi_map(kpis: DataFrame) -> DataFrame:
    """The nested form: contact -> map of window to its figures."""
    return kpis.groupBy("contact_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("window_days").cast("string"), F.lit("d")), F.struct("messages_in", "messages_out", "channels", "last_inbound", "last_outbound", "business_ratio", "keyword_hits")))).alias("windows"))


def first_last(events: DataFrame) -> DataFrame:
    at, way = F.col("ts"), F.col("direction")
    return usable(events).groupBy("contact_id").agg(F.min(at).alias("first_seen"), F.max(F.when(way == "inbound", at)).alias("last_inbound_ever"), F.max(F.when(way == "outbound", at)).alias("last_outbound_ever"))


def primary_channel(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Most used channel since as_of - days (no upper bound); ties to the first name."""
    counts = usable(events).where(F.col("ts") >= before(as_of, days)).groupBy("contact_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("contact_id").agg(F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("channel_primary"), F.max("n").alias("channel_messages"))


def awaiting_side(events: DataFrame) -> DataFrame:
    """Whose turn it is, by the direction of the latest message (ties to the larger id)."""
    latest = usable(events).groupBy("contact_id").agg(F.max_by("direction", F.struct("ts", "event_id")).alias("way"))
    return latest.select("contact_id", F.when(F.col("way") == "inbound", F.lit("mine")).otherwise(F.lit("theirs")).alias("awaiting_side"))


def response_pairs(events: DataFrame, trigger: str, response: str, thread: list[str], every: int = 86_400) -> DataFrame:
    """Each trigger with the next response of its thread; several triggers may
    share one. A response at the same instant makes no pair, nor one after it.

    A thread is cut into stretches of `every` seconds, so that one that holds much
    of all messages doesn't meet in one task. Within a stretch the next response is
    the last one seen when read backwards; where there is none it is the first one
    of a later stretch, of which each has a single row."""
    stretch = F.floor(F.unix_micros("ts") / (every * 1_000_000))
    cut = [*thread, "_stretch"]
    rows = events.withColumn("_stretch", stretch)
    seen = F.when(F.col("direction") == response, F.struct("ts", "event_id"))
    firsts = rows.groupBy(*cut).agg(F.min(seen).alias("_first"))
    later = Window.partitionBy(*thread).orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select(*cut, F.last("_first.ts", ignorenulls=True).over(later).alias("_later"))
    back = Window.partitionBy(*cut).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.last(F.when(F.col("direction") == response, F.col("ts")), ignorenulls=True).over(back)).where(F.col("direction") == trigger)
    same = F.lit(True)
    for c in cut:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    met = inside.alias("x").join(following.alias("y"), same, "left").select("x.*", "y._later")
    return met.withColumn("response_ts", F.coalesce("_inside", "_later")).where(F.col("response_ts") > F.col("ts")).drop("_stretch", "_inside", "_later")


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000)


def median_lag(pairs: DataFrame, by: list[str], longest: float = 336.0, least: int = 3) -> DataFrame:
    """Median hours of the lags up to `longest`; null below `least` pairs."""
    lag = pairs.withColumn("lag", hours(F.col("response_ts"), F.col("ts"))).where(F.col("lag") <= longest)
    return lag.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.median("lag").alias("m")).select(*by, "pairs", F.when(F.col("pairs") >= least, F.round("m", 1)).alias("median_lag_hours"))


def reply_lags(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Median hours until I answer (mine) and until they do (theirs) in a window."""
    inside = usable(events).where((F.col("ts") >= before(as_of, days)) & (F.col("ts") < instant(as_of)))
    sides = [("mine", "inbound", "outbound"), ("theirs", "outbound", "inbound")]
    out = None
    for side, trigger, response in sides:
        one = median_lag(response_pairs(inside, trigger, response, ["contact_id", "thread_id"]), ["contact_id"]).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out


def stale_sent(events: DataFrame, as_of: str, days: int = 7, within: int = 30) -> DataFrame:
    """Outbound messages of the last `within` days, at least `days` old, that no
    later inbound message of the thread follows. Threads are cut by days: a day's
    messages are looked at together, and a thread has one row a day after that."""
    thread, at = ["contact_id", "thread_id"], F.struct("ts", "event_id")
    recent = usable(events).where(F.col("ts") >= before(as_of, within)).withColumn("_day", F.to_date("ts"))
    answer = F.max(F.when(F.col("direction") == "inbound", at)).over(Window.partitionBy(*thread, "_day"))
    old = (F.col("direction") == "outbound") & (F.col("ts") <= before(as_of, days))
    open_ = recent.withColumns({"_answer": answer, "_old": old}).withColumn("_open", F.col("_old") & (F.col("_answer").isNull() | (at > F.col("_answer"))))
    by_day = open_.groupBy(*thread, "_day").agg(F.count_if("_open").alias("n"), F.max(F.col("_answer").isNotNull()).alias("answered"))
    last = F.max(F.when(F.col("answered"), F.col("_day"))).over(Window.partitionBy(*thread))
    counted = by_day.withColumn("_last", last)
    return counted.groupBy("contact_id").agg(F.coalesce(F.sum(F.when(F.col("_last").isNull() | (F.col("_day") >= F.col("_last")), F.col("n"))), F.lit(0)).alias("stale_sent"))


def engagement_bonus(kpi: DataFrame, as_of: str, points: dict = BONUS) -> DataFrame:
    """kpi: contact_id, messages_in, messages_out, n_channels, business_ratio,
    keyword_hits (of the shortest window, null without messages), awaiting_side,
    stale_sent, last_inbound_ever -> with column bonus."""
    p = points
    term = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))
    days = F.floor((F.unix_micros(instant(as_of)) - F.unix_micros("last_inbound_ever")) / F.lit(86_400_000_000))
    total = (
        term(F.col("awaiting_side") == "mine", p["awaiting"])
        + term(F.col("n_channels") >= 2, p["multichannel"])
        + term(F.col("keyword_hits") >= 1, p["keywords"])
        + term(F.col("business_ratio") >= p["hours_ratio"], p["hours"])
        + term(F.col("messages_in") - F.col("messages_out") > p["inbound_delta"], p["inbound_heavy"])
        + term(F.col("stale_sent") > p["stale_count"], p["stale"])
        + term(days > p["silence_days"], p["silence"])
    )
    return kpi.withColumn("bonus", F.greatest(F.lit(p["low"]), F.least(total, F.lit(p["high"]))))


def contact_kpis(events: DataFrame, as_of: str, days: tuple[int, ...] = DAYS, keywords: list[str] | None = None, **hours) -> DataFrame:
    """Everything the bonus needs, one row per contact; the shortest window's
    figures and the second window's main channel. Two passes over the events: one
    aggregation by contact and channel that a second one sums up by contact, and
    the window by thread for unanswered messages."""
    at, way = F.col("ts"), F.col("direction")
    short, middle = before(as_of, min(days)), before(as_of, sorted(days)[1] if len(days) > 1 else days[0])
    inside = (at >= short) & (at < instant(as_of))
    hits = keyword_hits(F.col("body"), keywords) if keywords else F.lit(0)
    by_channel = (
        usable(events)
        .groupBy("contact_id", "channel")
        .agg(
            F.min(at).alias("first"),
            F.max(F.when(way == "inbound", at)).alias("last_in"),
            F.max(F.when(way == "outbound", at)).alias("last_out"),
            F.max(F.struct(at, "event_id", way)).alias("latest"),
            F.count_if(inside & (way == "inbound")).alias("n_in"),
            F.count_if(inside & (way == "outbound")).alias("n_out"),
            F.sum(F.when(inside, business_hours(at, **hours).cast("int"))).alias("open"),
            F.sum(F.when(inside, hits)).alias("hits"),
            F.count_if(at >= middle).alias("n_middle"),
        )
    )
    n = F.sum("n_in") + F.sum("n_out")
    present = lambda c: F.when(n > 0, c)
    used = F.when(F.col("n_middle") > 0, F.struct(-F.col("n_middle"), "channel"))
    rolled = by_channel.groupBy("contact_id").agg(
        F.min("first").alias("first_seen"),
        F.max("last_in").alias("last_inbound_ever"),
        F.max("last_out").alias("last_outbound_ever"),
        F.max("latest").alias("latest"),
        present(F.sum("n_in")).alias("messages_in"),
        present(F.sum("n_out")).alias("messages_out"),
        present(F.count_if(F.col("n_in") + F.col("n_out") > 0)).alias("n_channels"),
        present(F.round(F.sum("open") / n, 2)).alias("business_ratio"),
        present(F.sum("hits")).alias("keyword_hits"),
        F.min(used).alias("main"),
    )
    side = F.when(F.col("latest.direction") == "inbound", "mine").otherwise("theirs")
    figures = rolled.select("contact_id", "first_seen", "last_inbound_ever", "last_outbound_ever", "messages_in", "messages_out", "n_channels", "business_ratio", "keyword_hits", side.alias("awaiting_side"), F.col("main.channel").alias("channel_primary"))
    return figures.join(stale_sent(events, as_of), "contact_id", "left")


def staleness(ts: Column, as_of: str) -> Column:
    """fresh under 12 h, hours under 48, days under 336, else stale; missing if null."""
    age = hours(instant(as_of), ts)
    return F.when(ts.isNull(), "missing").when(age < 12, "fresh").when(age < 48, "hours").when(age < 336, "days").otherwise("stale")


def mass_event(attendees: Column, title: Column, most: int = 10) -> Column:
    """Events with many attendees or a title of a mass mailing."""
    return (F.size(attendees) > most) | F.lower(F.coalesce(title, F.lit(""))).rlike(r"webinar|newsletter|all[ -]?hands|conference|town ?hall|company[ -]?wide")


def mass_mail(recipients: Column, most: int = 10) -> Column:
    """Recipients are counted by their @ signs."""
    return F.regexp_count(F.coalesce(recipients, F.lit("")), F.lit("@")) > most


def last_per_address(messages: DataFrame, address: str, at: str, *keep: str) -> DataFrame:
    """The latest message of each address."""
    return messages.groupBy(address).agg(F.max_by(F.struct(at, *keep), F.struct(at, *keep)).alias("m")).select(address, "m.*")
