"""Queries of what is kept between runs: days, learned matches, search indexes,
generations; and of phone numbers by a numbering plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import daily, phones
from ..operators import resolve as R
from ..operators import scoring as S
from ..operators.outreach import filter_rows, undecided
from ..session import table
from ..shared import shared_dir
from ..sources import files
from ..streaming import ingest as I
from .views import DAYS, INTERACTIONS, interactions

NOON = "2024-01-27 12:34:56"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept_days(spark, sf):
    """Windows as of an instant within a day, from three batches of kept days."""
    events, path = interactions(spark, sf), _folder(spark, "days")
    for k in range(3):
        daily.add_batch(events.where(F.col("event_id") % 3 == k), path, str(k))
    out = daily.window_figures(daily.read_days(spark, path), events, NOON, DAYS)
    return out.select("contact_id", F.col("window_days").cast("long").alias("window_days"), "messages_in", "messages_out", F.array_join("channels", ",").alias("channels"), F.unix_micros("last_inbound").alias("last_inbound_us"), "business_ratio")


KEPT_DAYS = f"""WITH {INTERACTIONS}, w AS (SELECT * FROM (VALUES {", ".join(f"({d})" for d in DAYS)}) t(d))
SELECT contact_id, CAST(d AS BIGINT) AS window_days, count(*) FILTER (direction = 'inbound') AS messages_in, count(*) FILTER (direction = 'outbound') AS messages_out, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels,
 epoch_us(max(ts) FILTER (direction = 'inbound')) AS last_inbound_us,
 round(count(*) FILTER (isodow(timezone('Europe/Bratislava', timezone('UTC', ts))) < 6 AND hour(timezone('Europe/Bratislava', timezone('UTC', ts))) BETWEEN 9 AND 17) / count(*), 2) AS business_ratio
FROM i, w WHERE ts >= TIMESTAMP '{NOON}' - to_days(d) AND ts < TIMESTAMP '{NOON}' GROUP BY ALL"""


def kept_history(spark, sf):
    """All of history from kept days, merged to one row a day."""
    events, path, one = interactions(spark, sf), _folder(spark, "days"), _folder(spark, "days")
    for k in range(2):
        daily.add_batch(events.where(F.col("event_id") % 2 == k), path, str(k))
    daily.compact(spark, path, one)
    days = daily.read_days(spark, one)
    main = daily.main_channel(days, "2024-01-31 00:00:00", 30)
    return daily.history_figures(days).join(main, "contact_id", "left").select("contact_id", "awaiting_side", "channel_primary", *(F.unix_micros(c).alias(f"{c}_us") for c in ("first_seen", "last_inbound_ever", "last_outbound_ever")))


KEPT_HISTORY = f"""WITH {INTERACTIONS}, n AS (SELECT contact_id, channel FROM i WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY contact_id, channel QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, channel) = 1)
SELECT i.contact_id, CASE WHEN arg_max(direction, {{'ts': ts, 'id': event_id}}) = 'inbound' THEN 'mine' ELSE 'theirs' END AS awaiting_side, any_value(n.channel) AS channel_primary, epoch_us(min(ts)) AS first_seen_us,
 epoch_us(max(ts) FILTER (direction = 'inbound')) AS last_inbound_ever_us, epoch_us(max(ts) FILTER (direction = 'outbound')) AS last_outbound_ever_us FROM i LEFT JOIN n USING (contact_id) GROUP BY i.contact_id"""


def learned_matches(spark, sf):
    """Events as a stream in which every seventh comes twice; a user's contact is
    known from purchases of over 97, all other events learn it from those."""
    run = _folder(spark, "matches")
    events = I.read_stream(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", pathGlobFilter="events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("handle"), "event_id", F.when((F.col("event_type") == "purchase") & (F.col("value") > 97), F.concat(F.lit("people/"), "user_id")).alias("contact_id"), "ts")
    twice = rows.unionByName(rows.where("event_id % 7 = 0"))
    query = I.matched_stream(twice).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("handle string, event_id long, contact_id string, replayed boolean").parquet(f"{run}/out").groupBy("contact_id").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("event_ids"))


LEARNED_MATCHES = """WITH k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 97)
SELECT concat('people/', user_id) AS contact_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS event_ids FROM events JOIN k USING (user_id) GROUP BY user_id"""


def indexed_search(spark, sf):
    """Orders as change logs by month, indexed, then searched; the last files come
    after the index was made."""
    folder, index = _folder(spark, "log"), _folder(spark, "index")
    o = table(spark, sf, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    log = o.select(F.lit(None).cast("string").alias("type"), F.col("o_orderdate").alias("timestamp"), F.concat(F.lit("people/c"), "o_custkey").alias("resourceName"), F.concat(F.lit("status["), "o_orderstatus", F.lit("]")).alias("field"), F.lit("").alias("old"), F.concat(F.lit("Order "), "o_orderkey").alias("new"), F.col("o_orderpriority").alias("reason"), month.alias("month"))
    first = F.col("month") < "1998"
    log.where(first).repartition("month").write.mode("append").json(folder)
    files.index_log(spark, folder, index)
    log.where(~first).repartition("month").write.mode("append").json(folder)
    found = None
    for needle in ("order 77", "C12 STATUS[o", "4-not"):
        one = files.search_log(spark, folder, index, needle).select(F.lit(needle).alias("needle"), "resourceName", "new", "reason")
        found = one if found is None else found.unionByName(one)
    return found


INDEXED_SEARCH = """WITH l AS (SELECT concat('people/c', o_custkey) AS resourceName, concat('Order ', o_orderkey) AS new, o_orderpriority AS reason, lower(concat_ws(' ', concat('people/c', o_custkey), concat('status[', o_orderstatus, ']'), '', concat('Order ', o_orderkey), o_orderpriority)) AS hay FROM orders)
SELECT needle, resourceName, new, reason FROM l, (VALUES ('order 77'), ('C12 STATUS[o'), ('4-not')) n(needle) WHERE contains(hay, lower(needle))"""


def snapshot_generations(spark, sf):
    """Three generations of the customers, the second restored after the third."""
    root, c = _folder(spark, "generations"), table(spark, sf, "customer")
    for k in (2, 3, 5):
        files.write_generation(c.where(F.col("c_nationkey") % k == 0).select("c_custkey", "c_name"), root, f"every {k}")
    files.restore_generation(spark, root, 2)
    now = files.read_generation(spark, root).agg(F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first_name"))
    return files.generations(spark, root).select("generation", "data", "rows", "note").join(F.broadcast(now), F.lit(True))  # one row


SNAPSHOT_GENERATIONS = """WITH g AS (SELECT k, count(*) FILTER (c_nationkey % k = 0) AS rows, min(c_name) FILTER (c_nationkey % k = 0) AS first_name FROM customer, (VALUES (2), (3), (5)) v(k) GROUP BY k)
SELECT n::BIGINT AS generation, d::BIGINT AS data, g.rows, note, x.rows AS n, x.first_name FROM (VALUES (1, 1, 2, 'every 2'), (2, 2, 3, 'every 3'), (3, 3, 5, 'every 5'), (4, 2, 3, 'restored 2')) v(n, d, k, note) JOIN g ON g.k = v.k JOIN g x ON x.k = 3"""

#: Prefix, lengths, region, kind, trunk digit, size of the country code.
PLAN = [("1", [11], "US", "unknown", "1", 1), ("44", [12], "GB", "fixed_line", "0", 2), ("447", [12], "GB", "mobile", "0", 2), ("49", [11, 12], "DE", "fixed_line", "0", 2), ("4915", [13], "DE", "mobile", "0", 2), ("33", [11], "FR", "fixed_line", "0", 2), ("336", [11], "FR", "mobile", "0", 2), ("39", [10, 11, 12], "IT", "fixed_line", "", 2), ("421", [12], "SK", "fixed_line", "0", 3), ("4219", [12], "SK", "mobile", "0", 3), ("420", [12], "CZ", "fixed_line", "", 3), ("352", [9, 10, 11], "LU", "fixed_line", "", 3), ("43", [10, 11, 12, 13], "AT", "fixed_line", "0", 2), ("436", [12, 13], "AT", "mobile", "0", 2), ("41", [11], "CH", "fixed_line", "0", 2)]
_RAW = ["concat('+44 7', right(t, 3), ' ', left(t, 6))", "concat('0044 20 ', t)", "concat('+49 15', t, '-', left(t, 1))", "concat('+33 6 ', t)", "concat('+39 06 ', left(t, 6))", "concat('+1 (2', left(t, 2), ') ', right(t, 7))", "concat('0903', left(t, 6))", "concat('903', left(t, 6))", "concat('420 60', left(t, 7))", "concat('+352 ', left(t, 7))", "concat('+43 664/', t)", "concat('+41-44-', left(t, 7))", "concat('+999 ', t)", "'+44 77'", "concat('+49 30 ', t, t)", "'call me'", "''", "NULL"]
_RAW_CASE = "CASE c_custkey % 18 " + " ".join(f"WHEN {k} THEN {raw}" for k, raw in enumerate(_RAW)) + " END"


def international_phones(spark, sf):
    """Numbers of ten countries and eight kinds of failure, made from the keys."""
    c = table(spark, sf, "customer").withColumn("t", F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0"))
    numbers = c.select("c_custkey", F.expr(_RAW_CASE).alias("phone"))
    out = phones.normalise(numbers, spark.createDataFrame(PLAN, phones.PLAN), "421")
    return out.groupBy("region", "kind", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("e164").alias("least"), F.max("e164").alias("most"))


INTERNATIONAL_PHONES = f"""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS t FROM customer),
r AS (SELECT c_custkey, coalesce({_RAW_CASE}, '') AS raw FROM c),
g AS (SELECT *, regexp_replace(raw, '\\D', '', 'g') AS digits FROM r),
a AS (SELECT c_custkey, raw, digits, CASE WHEN raw LIKE '+%' THEN digits WHEN digits LIKE '00%' THEN digits[3:] WHEN digits LIKE '0%' THEN concat('421', digits[2:]) ELSE concat('421', digits) END AS d, 0 AS nth FROM g
 UNION ALL SELECT c_custkey, raw, digits, digits, 1 FROM g),
p AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {n}, '{r}', '{k}')" for p, n, r, k, _, _ in PLAN)}) v(prefix, lengths, region, kind)),
m AS (SELECT a.*, p.*, list_contains(lengths, length(d)) AS fits FROM a JOIN p ON digits <> '' AND starts_with(d, prefix)),
h AS (SELECT c_custkey, d, region, kind FROM m WHERE fits QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY nth, length(prefix) DESC) = 1),
f AS (SELECT c_custkey, length(d) AS n, list_max(lengths) AS most FROM m WHERE nth = 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) = 1),
o AS (SELECT concat('+', h.d) AS e164, region, kind, CASE WHEN raw = '' THEN 'empty' WHEN digits = '' THEN 'no digits' WHEN h.d IS NOT NULL THEN NULL WHEN f.n > f.most THEN 'too long' WHEN f.n < f.most THEN 'too short' ELSE 'unknown prefix' END AS reason, h.d
 FROM g LEFT JOIN h USING (c_custkey) LEFT JOIN f USING (c_custkey))
SELECT region, kind, reason, count(*) AS n, min(CASE WHEN d IS NOT NULL THEN e164 END) AS least, max(CASE WHEN d IS NOT NULL THEN e164 END) AS most FROM o GROUP BY ALL"""


def verified_changes(spark, sf):
    """Changed customers (of orders) against a snapshot that lacks some of them,
    beside the summary of their log with its end markers."""
    o = table(spark, sf, "orders")
    changes = o.select(F.lit(None).cast("string").alias("type"), F.col("o_custkey").alias("resource_name"), (F.col("o_totalprice") / 500000).alias("confidence"), F.lit(None).cast("int").alias("batch"), F.lit(None).cast("int").alias("success"), F.lit(None).cast("int").alias("failed"), F.col("o_orderdate").alias("at"))
    ends = o.where("o_orderkey % 50 = 0").select(F.lit("batch_end"), F.lit(None).cast("long"), F.lit(None).cast("double"), (F.col("o_orderkey") % 7).cast("int"), (F.col("o_custkey") % 11).cast("int"), (F.col("o_custkey") % 3).cast("int"), F.timestamp_seconds(F.col("o_orderkey")))
    summary = U.log_summary(changes.union(ends))
    check = U.verify_against(changes, table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("resource_name")))
    return summary.select("changes", "contacts", "high", "medium", "low", "success", "failed").join(F.broadcast(check), F.lit(True))  # one row each


VERIFIED_CHANGES = """WITH l AS (SELECT o_custkey, o_totalprice / 500000 AS c FROM orders), e AS (SELECT o_orderkey % 7 AS b, o_custkey % 11 AS s, o_custkey % 3 AS f FROM orders WHERE o_orderkey % 50 = 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey DESC) = 1)
SELECT count(*) AS changes, count(DISTINCT o_custkey) AS contacts, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.6 AND c < 0.9) AS medium, count(*) FILTER (c < 0.6) AS low, (SELECT CAST(sum(s) AS BIGINT) FROM e) AS success, (SELECT CAST(sum(f) AS BIGINT) FROM e) AS failed,
 count(DISTINCT o_custkey) AS changed, count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS missing FROM l"""


def score_figures(spark, sf):
    """Signals, completeness and bonus of the customers as scored contacts."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(F.element_at(F.array(*map(F.lit, ("job_change", "active", "profile", "no_activity", "other"))), (k % 5 + 1).cast("int")).alias("signal"), (k % 4).alias("completeness"), F.when(k % 3 != 0, (k % 9).cast("double")).alias("bonus"))
    return S.score_stats(rows)


SCORE_FIGURES = """SELECT count(*) AS total, count(*) FILTER (c_custkey % 5 = 0) AS job_change, count(*) FILTER (c_custkey % 5 = 1) AS active, count(*) FILTER (c_custkey % 5 = 2) AS profile, count(*) FILTER (c_custkey % 5 = 3) AS no_activity, round(avg(c_custkey % 4), 1) AS avg_completeness,
 count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 9 <> 0) AS enriched, round(avg(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 9 END), 1) AS avg_bonus FROM customer"""

def filtered_list(spark, sf):
    """Orders as cards of a list, narrowed by text, stage, kind, beginning and
    presence, and by what has no decision."""
    o = table(spark, sf, "orders")
    cards = o.select(F.col("o_orderkey").alias("change_id"), F.concat(F.lit("Card "), "o_custkey").alias("name"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("org"), F.col("o_orderstatus").alias("stage"), F.array("o_orderpriority", F.concat(F.lit("k"), F.col("o_orderkey") % 4)).alias("kinds"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("seen")).alias("signal"))
    open_ = undecided(cards, o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("change_id")))
    found = filter_rows(open_, "LOW", ("name", "org"), {"stage": "O", "name": "all"}, {"name": "Card 1"}, {"kinds": "k2"}, {"signal": True})
    return found.select("change_id", "name", "org")


FILTERED_LIST = """SELECT o_orderkey AS change_id, concat('Card ', o_custkey) AS name, o_orderpriority AS org FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 0 AND contains(lower(o_orderpriority), 'low') AND o_orderstatus = 'O'
 AND starts_with(CAST(o_custkey AS VARCHAR), '1') AND o_orderkey % 4 = 2"""


def signal_kinds(spark, sf):
    return S.signal_counts(table(spark, sf, "customer").select(F.element_at(F.array(*map(F.lit, ("job_change", "active", "profile", "odd"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("signal_type")))


SIGNAL_KINDS = """SELECT k AS signal_type, count(c_custkey) AS n FROM (VALUES ('job_change', 0), ('active', 1), ('profile', 2), ('no_activity', -1), ('other', 3)) v(k, m) LEFT JOIN customer ON c_custkey % 4 = m GROUP BY k"""


def ranked_pairs(spark, sf):
    """Pairs of suppliers in the order a list shows them."""
    p = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("/", "s_nationkey", F.floor(F.col("s_acctbal") / 500)).alias("key"))
    pairs = R.equal_pairs(p, "s_suppkey", "key").select("a", "b", F.element_at(F.array(F.lit("phone"), F.lit("email"), F.lit("name")), (F.col("a") % 3 + 1).cast("int")).alias("match_type"), (F.lit(0.9) - F.col("b") % 2 * F.lit(0.1)).alias("confidence"))
    return R.sorted_pairs(pairs).select("a", "b", "match_type", "place")


RANKED_PAIRS = """WITH p AS (SELECT s_suppkey AS k, concat_ws('/', s_nationkey, CAST(floor(s_acctbal / 500) AS BIGINT)) AS key FROM supplier), m AS (SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.key = y.key AND x.k < y.k)
SELECT a, b, ['phone', 'email', 'name'][1 + a % 3] AS match_type, row_number() OVER (ORDER BY b % 2, a % 3, a, b) AS place FROM m"""

QUERIES = {
    "kept_days": (kept_days, KEPT_DAYS),
    "kept_history": (kept_history, KEPT_HISTORY),
    "learned_matches": (learned_matches, LEARNED_MATCHES),
    "indexed_search": (indexed_search, INDEXED_SEARCH),
    "snapshot_generations": (snapshot_generations, SNAPSHOT_GENERATIONS),
    "international_phones": (international_phones, INTERNATIONAL_PHONES),
    "verified_changes": (verified_changes, VERIFIED_CHANGES),
    "score_figures": (score_figures, SCORE_FIGURES),
    "filtered_list": (filtered_list, FILTERED_LIST),
    "signal_kinds": (signal_kinds, SIGNAL_KINDS),
    "ranked_pairs": (ranked_pairs, RANKED_PAIRS),
}
