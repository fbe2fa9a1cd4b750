"""Change log, feedback and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import feedback as B
from ..operators.outreach import with_delta
from ..session import table
from .views import EVENT_CHANGES, event_changes, order_log

_BAND = "CASE WHEN {0} >= 0.90 THEN 'high' WHEN {0} >= 0.60 THEN 'medium' ELSE 'low' END"


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    # the discount's whole percent makes the confidence, so that thresholds are met exactly
    c = F.round(F.lit(1) - F.round(F.col("l_discount") * 100) * F.lit(5) / 100, 2)
    return li.select(F.col("l_orderkey").alias("resource_name"), F.col("l_linenumber").alias("seq"), c.alias("confidence"), F.concat(F.lit("urls"), F.col("l_returnflag")).alias("field"), "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")


_LINES = "l AS (SELECT l_orderkey AS resource_name, l_linenumber AS seq, round(1 - round(l_discount * 100) * 5 / 100, 2) AS confidence, l_returnflag, l_linestatus FROM lineitem)"


def change_bands(spark, sf):
    return U.contact_stats(_lines(spark, sf))


CHANGE_BANDS = f"""WITH {_LINES}, b AS (SELECT resource_name, {_BAND.format('confidence')} AS band FROM l)
SELECT resource_name, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low, count(*) AS total FROM b GROUP BY resource_name"""


def run_summary(spark, sf):
    return U.run_summary(_lines(spark, sf), "l_returnflag")


RUN_SUMMARY = f"""WITH {_LINES}, b AS (SELECT {_BAND.format('confidence')} AS band, l_returnflag FROM l)
SELECT 'band' AS dimension, band AS value, count(*) AS n FROM b GROUP BY band UNION ALL SELECT 'kind', l_returnflag, count(*) FROM b GROUP BY l_returnflag UNION ALL SELECT 'all', 'all', count(*) FROM b"""


def batches(spark, sf):
    stats = U.contact_stats(_lines(spark, sf))
    b = U.batches(stats)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("contacts"), *(F.sum(c).alias(c) for c in ("high", "medium", "low", "total")))


BATCHES = f"""WITH {_LINES}, b AS (SELECT resource_name, {_BAND.format('confidence')} AS band FROM l),
s AS (SELECT resource_name, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low, count(*) AS total FROM b GROUP BY resource_name),
r AS (SELECT *, CAST(ceil(row_number() OVER (ORDER BY high DESC, total DESC, resource_name) / 50.0) AS BIGINT) AS batch FROM s)
SELECT batch, count(*) AS contacts, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY batch"""


def dup_within_group(spark, sf):
    d = U.repeated_within(_lines(spark, sf), ["resource_name"], "l_suppkey", ["seq"])
    return d.groupBy("resource_name").agg(F.count_if("is_duplicate").alias("repeats")).where("repeats > 0")


DUP_WITHIN_GROUP = """WITH d AS (SELECT l_orderkey AS resource_name, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS n FROM lineitem)
SELECT resource_name, count(*) AS repeats FROM d WHERE n > 1 GROUP BY resource_name"""


def rule_category(spark, sf):
    e = table(spark, sf, "events")
    reasons = F.element_at(F.array(*(F.lit(r) for r in REASONS)), (F.col("event_id") % len(REASONS) + 1).cast("int"))
    return e.groupBy(U.rule_category(reasons).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


#: Reasons with which the ordered categories are exercised.
REASONS = ["diacritics restored", "phone number normalization", "phone type detection (mobile)", "phone number found in note", "email normalization (lowercase, trim)", "country inferred from postal code", "organization casing from postal code", "organization homepage", "Birthday in notes", "VAT id", "nothing known"]


def _category_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for n, p in U.CATEGORIES) + " ELSE 'other' END"


RULE_CATEGORY = f"""WITH r AS (SELECT value, ([{', '.join(repr(x) for x in REASONS)}])[CAST(event_id % {len(REASONS)} + 1 AS INT)] AS reason FROM events)
SELECT {_category_sql('reason')} AS category, count(*) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY 1"""


def _decided(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "source")
    d = labels.join(docs, "doc_id")
    return d.select(F.col("source").alias("category"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("edited").alias("decision"))


_DECIDED = "d AS (SELECT source AS category, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'edited' END AS decision FROM labels JOIN documents USING (doc_id))"


def bayes_confidence(spark, sf):
    return B.rule_stats(_decided(spark, sf))


BAYES_CONFIDENCE = f"""WITH {_DECIDED}, s AS (SELECT category, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'edited') AS edited, count(*) AS total FROM d GROUP BY category)
SELECT *, CASE WHEN total >= 5 THEN least(greatest(round((7.5 + approved + edited)::DOUBLE / (10.0 + total)::DOUBLE, 3), 0.30::DOUBLE), 0.98::DOUBLE) END AS confidence FROM s"""


def approval_rate(spark, sf):
    return B.approval_rate(_decided(spark, sf))


APPROVAL_RATE = f"WITH {_DECIDED} SELECT category, count(*) AS decided, round(count(*) FILTER (decision <> 'rejected')::DOUBLE / count(*), 4) AS rate FROM d GROUP BY category"


def adjusted_confidence(spark, sf):
    stats = B.rule_stats(_decided(spark, sf)).select("category", "confidence", "total", "approved", "edited")
    changes = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"), F.when(F.col("doc_id") % 3 == 0, 0.97).otherwise(0.70).alias("confidence"))
    return B.adjust(changes, stats).select("doc_id", "category", "confidence")


ADJUSTED_CONFIDENCE = f"""WITH {_DECIDED}, s AS (SELECT category, count(*) FILTER (decision <> 'rejected') AS yes, count(*) AS total FROM d GROUP BY category)
SELECT doc_id, source AS category, CASE WHEN doc_id % 3 = 0 THEN 0.97::DOUBLE WHEN total >= 5 THEN least(greatest(round((7.5 + yes)::DOUBLE / (10.0 + total)::DOUBLE, 3), 0.30::DOUBLE), 0.98::DOUBLE)
 WHEN total > 0 THEN round((7.0 + yes)::DOUBLE / (10.0 + total)::DOUBLE, 3) ELSE 0.70::DOUBLE END AS confidence FROM documents LEFT JOIN s ON source = category"""


def change_id(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", B.change_id(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("change_id"))


CHANGE_ID = "SELECT o_orderkey, substr(sha256(concat_ws('|', o_custkey::VARCHAR, o_orderstatus, o_orderpriority)), 1, 12) AS change_id FROM orders"


def first_wins_dedup(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return U.first_wins(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "day")


FIRST_WINS_DEDUP = "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) = 1"


def latest_decision(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("-", "user_id", F.get_json_object("props", "$.k").cast("int") % 10).alias("change_id"), F.col("event_type").alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    return B.latest_decisions(e).select("change_id", "decision")


LATEST_DECISION = """SELECT concat(user_id, '-', CAST(json_extract_string(props, '$.k') AS INT) % 10) AS change_id, event_type AS decision FROM events
QUALIFY row_number() OVER (PARTITION BY concat(user_id, '-', CAST(json_extract_string(props, '$.k') AS INT) % 10) ORDER BY ts DESC, event_id DESC) = 1"""


def roundtrip_suppress(spark, sf):
    return U.suppress_round_trips(event_changes(spark, sf)).select("resource_name", "field", "seq", "old", "new")


ROUNDTRIP_SUPPRESS = f"""WITH {EVENT_CHANGES}, m AS (SELECT *, count(*) OVER g AS n, first_value(old) OVER o AS f, last_value(new) OVER o AS t FROM c
 WINDOW g AS (PARTITION BY resource_name, field), o AS (PARTITION BY resource_name, field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT resource_name, field, seq, old, new FROM m WHERE NOT (n > 1 AND f = t)"""


def rollback_state(spark, sf):
    return U.rollback_state(event_changes(spark, sf))


ROLLBACK_STATE = f"WITH {EVENT_CHANGES} SELECT resource_name, field, arg_min(old, seq) AS restore, arg_max(new, seq) AS current, count(*) AS undone FROM c GROUP BY ALL"


def daily_runs(spark, sf):
    return U.daily_runs(order_log(spark, sf)).withColumn("day", F.col("day").cast("string"))


DAILY_RUNS = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS changes, count(DISTINCT o_custkey) AS contacts FROM orders GROUP BY 1"


def latest_day(spark, sf):
    return U.latest_day(order_log(spark, sf)).withColumn("last_day", F.col("last_day").cast("string"))


LATEST_DAY = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS last_day, count(*) AS changes, count(DISTINCT o_custkey) AS contacts FROM orders WHERE date_trunc('day', o_orderdate) = (SELECT date_trunc('day', max(o_orderdate)) FROM orders) GROUP BY 1"


def top_reasons(spark, sf):
    o = order_log(spark, sf).select("field", F.concat(F.lit("reason "), (F.col("resource_name") % 37).cast("string")).alias("reason"))
    return U.top_per_group(o, "field", "reason", 10).withColumn("position", F.col("position").cast("long"))


TOP_REASONS = """WITH c AS (SELECT o_orderstatus AS field, concat('reason ', o_custkey % 37) AS reason, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, reason) AS position FROM c QUALIFY position <= 10"""


def grouped_changelog_page(spark, sf):
    log = order_log(spark, sf).withColumns({"old": F.lit(""), "new": F.col("reason")})
    g = U.grouped_log(log).select("resource_name", "entries", F.unix_micros("latest").alias("latest_us"), F.element_at("changes", 1).new.alias("newest"))
    return U.page(g, [F.desc("latest_us"), F.col("resource_name")], 2, 20)


GROUPED_CHANGELOG_PAGE = """WITH g AS (SELECT o_custkey AS resource_name, count(*) AS entries, epoch_us(max(o_orderdate)) AS latest_us, max({'at': o_orderdate, 'field': o_orderstatus, 'old': '', 'new': o_orderpriority}).new AS newest FROM orders GROUP BY 1)
SELECT * FROM g ORDER BY latest_us DESC, resource_name LIMIT 20 OFFSET 20"""


def top_contacts(spark, sf):
    return U.top_contacts(order_log(spark, sf)).select("resource_name", "changes", F.unix_micros("latest").alias("latest_us"))


TOP_CONTACTS = "SELECT o_custkey AS resource_name, count(*) AS changes, epoch_us(max(o_orderdate)) AS latest_us FROM orders GROUP BY 1 ORDER BY changes DESC, resource_name LIMIT 10"


def changelog_search(spark, sf):
    log = order_log(spark, sf).withColumns({"old": F.lit(""), "new": F.col("reason")})
    return U.search(log, needle="URGENT", field="O", bands=["medium", "high"]).select("resource_name", "seq", "field")


CHANGELOG_SEARCH = "SELECT o_custkey AS resource_name, o_orderkey AS seq, o_orderstatus AS field FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus LIKE '%O%' AND o_totalprice / 500000 >= 0.60"


def follower_delta(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    deltas = with_delta(n.select(F.col("event_type").alias("account"), F.col("d").alias("at"), F.col("n").alias("followers")))
    return deltas.select(F.col("account").alias("event_type"), F.col("at").cast("string").alias("day"), F.col("followers").alias("n"), "delta")


FOLLOWER_DELTA = "WITH n AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL) SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM n"


def keep_last_n(spark, sf):
    e = table(spark, sf, "events")
    return U.keep_last(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


KEEP_LAST_N = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"


def review_stats(spark, sf):
    return U.review_stats(_lines(spark, sf), "l_returnflag", "l_linestatus")


REVIEW_STATS = f"WITH {_LINES} SELECT l_returnflag, l_linestatus, count(*) AS n, min(confidence) AS low, max(confidence) AS high FROM l WHERE confidence >= 0.60 AND confidence < 0.90 GROUP BY ALL"


def merged_rule_stats(spark, sf):
    s = B.rule_stats(_decided(spark, sf))
    renames = spark.createDataFrame([("src1", "group one"), ("src", "others"), ("src12", "twelve")], "prefix string, target string")
    return B.merge_stats(s, renames)


MERGED_RULE_STATS = f"""WITH {_DECIDED} SELECT CASE WHEN category LIKE 'src12%' THEN 'twelve' WHEN category LIKE 'src1%' THEN 'group one' WHEN category LIKE 'src%' THEN 'others' ELSE category END AS category,
count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'edited') AS edited FROM d GROUP BY 1"""


def rejected_specifics(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("resource_name"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("new"), "o_orderkey")
    rejected = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("resource_name"), F.lit("O").alias("field"), F.lit("1-URGENT").alias("new"))
    return B.without_rejected(o, rejected).groupBy("field", "new").agg(F.count(F.lit(1)).alias("n"))


REJECTED_SPECIFICS = """SELECT o_orderstatus AS field, o_orderpriority AS new, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY ALL"""

QUERIES = {
    "change_bands": (change_bands, CHANGE_BANDS),
    "run_summary": (run_summary, RUN_SUMMARY),
    "batches": (batches, BATCHES),
    "dup_within_group": (dup_within_group, DUP_WITHIN_GROUP),
    "rule_category": (rule_category, RULE_CATEGORY),
    "bayes_confidence": (bayes_confidence, BAYES_CONFIDENCE),
    "approval_rate": (approval_rate, APPROVAL_RATE),
    "adjusted_confidence": (adjusted_confidence, ADJUSTED_CONFIDENCE),
    "change_id": (change_id, CHANGE_ID),
    "first_wins_dedup": (first_wins_dedup, FIRST_WINS_DEDUP),
    "latest_decision": (latest_decision, LATEST_DECISION),
    "roundtrip_suppress": (roundtrip_suppress, ROUNDTRIP_SUPPRESS),
    "rollback_state": (rollback_state, ROLLBACK_STATE),
    "daily_runs": (daily_runs, DAILY_RUNS),
    "latest_day": (latest_day, LATEST_DAY),
    "top_reasons": (top_reasons, TOP_REASONS),
    "grouped_changelog_page": (grouped_changelog_page, GROUPED_CHANGELOG_PAGE),
    "top_contacts": (top_contacts, TOP_CONTACTS),
    "changelog_search": (changelog_search, CHANGELOG_SEARCH),
    "follower_delta": (follower_delta, FOLLOWER_DELTA),
    "keep_last_n": (keep_last_n, KEEP_LAST_N),
    "review_stats": (review_stats, REVIEW_STATS),
    "merged_rule_stats": (merged_rule_stats, MERGED_RULE_STATS),
    "rejected_specifics": (rejected_specifics, REJECTED_SPECIFICS),
}
