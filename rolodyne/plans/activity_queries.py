"""Engagement queries on events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators.labels import known
from ..session import table
from ..streaming.ingest import windowed_counts
from .views import AS_OF, DAYS, INTERACTIONS, interactions

_T = f"TIMESTAMP '{AS_OF}'"


def kpi_windows(spark, sf):
    k = A.window_kpis(interactions(spark, sf), AS_OF, DAYS)
    return k.select("contact_id", F.col("window_days").cast("long").alias("window_days"), "messages_in", "messages_out", F.array_join("channels", ",").alias("channels"), F.unix_micros("last_inbound").alias("last_inbound_us"), F.unix_micros("last_outbound").alias("last_outbound_us"), "business_ratio")


KPI_WINDOWS = f"""WITH {INTERACTIONS}, w AS (SELECT * FROM (VALUES (3), (10), (30)) t(d))
SELECT contact_id, CAST(d AS BIGINT) AS window_days, count(*) FILTER (direction = 'inbound') AS messages_in, count(*) FILTER (direction = 'outbound') AS messages_out,
 string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels,
 epoch_us(max(ts) FILTER (direction = 'inbound')) AS last_inbound_us, epoch_us(max(ts) FILTER (direction = 'outbound')) AS last_outbound_us,
 round(count(*) FILTER (isodow(timezone('Europe/Bratislava', timezone('UTC', ts))) < 6 AND hour(timezone('Europe/Bratislava', timezone('UTC', ts))) BETWEEN 9 AND 17) / count(*), 2) AS business_ratio
FROM i, w WHERE ts >= {_T} - to_days(d) AND ts < {_T} GROUP BY ALL"""


def kpi_channel_primary(spark, sf):
    return A.primary_channel(interactions(spark, sf), AS_OF, 30)


KPI_CHANNEL_PRIMARY = f"""WITH {INTERACTIONS}, n AS (SELECT contact_id, channel, count(*) AS n FROM i WHERE ts >= {_T} - INTERVAL 30 DAY GROUP BY ALL)
SELECT contact_id, channel AS channel_primary, n AS channel_messages FROM n QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, channel) = 1"""


def kpi_awaiting_side(spark, sf):
    return A.awaiting_side(interactions(spark, sf))


KPI_AWAITING_SIDE = f"""WITH {INTERACTIONS} SELECT contact_id, CASE WHEN direction = 'inbound' THEN 'mine' ELSE 'theirs' END AS awaiting_side FROM i
QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY ts DESC, event_id DESC) = 1"""


def kpi_first_last(spark, sf):
    f = A.first_last(interactions(spark, sf))
    return f.select("contact_id", *(F.unix_micros(c).alias(c + "_us") for c in ("first_seen", "last_inbound_ever", "last_outbound_ever")))


KPI_FIRST_LAST = f"""WITH {INTERACTIONS} SELECT contact_id, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts) FILTER (direction = 'inbound')) AS last_inbound_ever_us,
epoch_us(max(ts) FILTER (direction = 'outbound')) AS last_outbound_ever_us FROM i GROUP BY contact_id"""


def business_hours_ratio(spark, sf):
    i = interactions(spark, sf)
    return i.groupBy("contact_id").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg(A.business_hours(F.col("ts")).cast("int")), 2).alias("ratio"))


BUSINESS_HOURS_RATIO = f"""WITH {INTERACTIONS}, z AS (SELECT contact_id, timezone('Europe/Bratislava', timezone('UTC', ts)) AS t FROM i)
SELECT contact_id, count(*) AS messages, round(avg(CASE WHEN isodow(t) < 6 AND hour(t) BETWEEN 9 AND 17 THEN 1 ELSE 0 END), 2) AS ratio FROM z GROUP BY contact_id"""


def reply_lag(spark, sf):
    return A.reply_lags(interactions(spark, sf), AS_OF, 30).select("contact_id", "side", "pairs", "median_lag_hours")


REPLY_LAG = f"""WITH {INTERACTIONS}, w AS (SELECT * FROM i WHERE ts >= {_T} - INTERVAL 30 DAY AND ts < {_T}),
n AS (SELECT contact_id, direction, ts,
 first_value(CASE WHEN direction = 'outbound' THEN ts END IGNORE NULLS) OVER f AS next_out, first_value(CASE WHEN direction = 'inbound' THEN ts END IGNORE NULLS) OVER f AS next_in
 FROM w WINDOW f AS (PARTITION BY contact_id, thread_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (SELECT contact_id, 'mine' AS side, (epoch_us(next_out) - epoch_us(ts)) / 3600000000.0 AS lag FROM n WHERE direction = 'inbound' AND next_out > ts
 UNION ALL SELECT contact_id, 'theirs', (epoch_us(next_in) - epoch_us(ts)) / 3600000000.0 FROM n WHERE direction = 'outbound' AND next_in > ts)
SELECT contact_id, side, count(*) AS pairs, CASE WHEN count(*) >= 3 THEN round(median(CAST(lag AS DOUBLE)), 1) END AS median_lag_hours FROM p WHERE lag <= 336 GROUP BY ALL"""


def conversation_pairs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ts", F.col("turn").cast("timestamp"))
    e = c.select("conv_id", F.col("turn").alias("event_id"), "ts", F.col("role").alias("direction"), "turn")
    pairs = A.response_pairs(e, "user", "assistant", ["conv_id"])
    return pairs.select("conv_id", F.col("turn").alias("user_turn"), F.col("response_ts").cast("long").alias("assistant_turn"))


CONVERSATION_PAIRS = """WITH n AS (SELECT conv_id, turn, role, first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER
 (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM conversations)
SELECT conv_id, turn AS user_turn, a AS assistant_turn FROM n WHERE role = 'user' AND a > turn"""


def stale_outbound(spark, sf):
    return A.stale_sent(interactions(spark, sf), AS_OF)


STALE_OUTBOUND = f"""WITH {INTERACTIONS}, r AS (SELECT * FROM i WHERE ts >= {_T} - INTERVAL 30 DAY)
SELECT contact_id, count(*) FILTER (direction = 'outbound' AND ts <= {_T} - INTERVAL 7 DAY AND NOT EXISTS (SELECT 1 FROM r q WHERE q.contact_id = r.contact_id AND q.thread_id = r.thread_id
 AND q.direction = 'inbound' AND (q.ts, q.event_id) > (r.ts, r.event_id))) AS stale_sent FROM r GROUP BY contact_id"""


def engagement_bonus(spark, sf):
    k = A.engagement_bonus(A.contact_kpis(interactions(spark, sf), AS_OF, DAYS), AS_OF)
    return k.select("contact_id", "messages_in", "messages_out", "awaiting_side", "stale_sent", "bonus")


ENGAGEMENT_BONUS = f"""WITH {INTERACTIONS},
s AS (SELECT contact_id, count(*) FILTER (direction = 'inbound') AS messages_in, count(*) FILTER (direction = 'outbound') AS messages_out, count(DISTINCT channel) AS ch,
 round(count(*) FILTER (isodow(timezone('Europe/Bratislava', timezone('UTC', ts))) < 6 AND hour(timezone('Europe/Bratislava', timezone('UTC', ts))) BETWEEN 9 AND 17) / count(*), 2) AS bh
 FROM i WHERE ts >= {_T} - INTERVAL 3 DAY AND ts < {_T} GROUP BY contact_id),
a AS (SELECT contact_id, CASE WHEN direction = 'inbound' THEN 'mine' ELSE 'theirs' END AS awaiting_side FROM i QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY ts DESC, event_id DESC) = 1),
st AS ({STALE_OUTBOUND.split('WITH ' + INTERACTIONS + ', ')[1].replace('r AS (', 'SELECT * FROM (WITH r AS (', 1)})),
e AS (SELECT contact_id, max(ts) FILTER (direction = 'inbound') AS li FROM i GROUP BY contact_id)
SELECT contact_id, messages_in, messages_out, awaiting_side, stale_sent, greatest(-20.0::DOUBLE, least(40.0::DOUBLE,
 CASE WHEN awaiting_side = 'mine' THEN 15 ELSE 0 END + CASE WHEN ch >= 2 THEN 10 ELSE 0 END + CASE WHEN bh >= 0.7 THEN 5 ELSE 0 END + CASE WHEN messages_in - messages_out > 5 THEN 8 ELSE 0 END
 + CASE WHEN stale_sent > 3 THEN -10 ELSE 0 END + CASE WHEN date_diff('day', li, {_T}) > 180 THEN -15 ELSE 0 END)) AS bonus
FROM e LEFT JOIN s USING (contact_id) LEFT JOIN a USING (contact_id) LEFT JOIN st USING (contact_id)"""


def staleness(spark, sf):
    last = interactions(spark, sf).groupBy("contact_id").agg(F.max("ts").alias("last"))
    return last.groupBy(A.staleness(F.col("last"), AS_OF).alias("class")).agg(F.count(F.lit(1)).alias("contacts"))


STALENESS = f"""WITH {INTERACTIONS}, l AS (SELECT contact_id, (epoch_us({_T}) - epoch_us(max(ts))) / 3600000000.0 AS h FROM i GROUP BY contact_id)
SELECT CASE WHEN h IS NULL THEN 'missing' WHEN h < 12 THEN 'fresh' WHEN h < 48 THEN 'hours' WHEN h < 336 THEN 'days' ELSE 'stale' END AS class, count(*) AS contacts FROM l GROUP BY 1"""


def tumbling_counts(spark, sf):
    """Beyond the surveyed operators: tumbling day windows by channel."""
    i = interactions(spark, sf)
    return windowed_counts(i, "ts", "1 day", "24 hours", "channel").select(F.to_date("window.start").cast("string").alias("day"), "channel", "n")


TUMBLING_COUNTS = f"WITH {INTERACTIONS} SELECT strftime(ts, '%Y-%m-%d') AS day, channel, count(*) AS n FROM i GROUP BY ALL"


def known_attendees(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return known(table(spark, sf, "events"), c, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


KNOWN_ATTENDEES = "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id"

def last_contact_message(spark, sf):
    m = table(spark, sf, "conversations")
    last = A.last_per_address(m.where("role = 'user'"), "conv_id", "turn", "text")
    return last.select("conv_id", "turn", F.length("text").cast("long").alias("size"))


LAST_CONTACT_MESSAGE = "SELECT conv_id, turn, length(text) AS size FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1"

QUERIES = {
    "kpi_windows": (kpi_windows, KPI_WINDOWS),
    "kpi_channel_primary": (kpi_channel_primary, KPI_CHANNEL_PRIMARY),
    "kpi_awaiting_side": (kpi_awaiting_side, KPI_AWAITING_SIDE),
    "kpi_first_last": (kpi_first_last, KPI_FIRST_LAST),
    "business_hours_ratio": (business_hours_ratio, BUSINESS_HOURS_RATIO),
    "reply_lag": (reply_lag, REPLY_LAG),
    "conversation_pairs": (conversation_pairs, CONVERSATION_PAIRS),
    "stale_outbound": (stale_outbound, STALE_OUTBOUND),
    "engagement_bonus": (engagement_bonus, ENGAGEMENT_BONUS),
    "staleness": (staleness, STALENESS),
    "tumbling_counts": (tumbling_counts, TUMBLING_COUNTS),
    "known_attendees": (known_attendees, KNOWN_ATTENDEES),
    "last_contact_message": (last_contact_message, LAST_CONTACT_MESSAGE),
}
