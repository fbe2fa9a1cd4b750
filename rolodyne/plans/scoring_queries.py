"""Ranking and lead queries on customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..session import table
from .views import TODAY, order_activity

_ACT = "a AS (SELECT o_custkey AS id, CAST(max(o_orderdate) AS DATE) AS last_date, count(DISTINCT o_orderstatus) AS interactions, count(*) AS orders FROM orders GROUP BY 1)"
_GAP = f"date_diff('day', last_date, DATE '{TODAY}') / 30.0::DOUBLE"


def followup_rank(spark, sf):
    c, a = table(spark, sf, "customer"), order_activity(spark, sf)
    rows = c.join(a, c.c_custkey == a.id, "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "last_date", S.months_gap(F.col("last_date"), TODAY).alias("months_gap"), F.coalesce("interactions", F.lit(0)).alias("interactions"),
        F.when(F.col("c_custkey") % 11 == 0, "job_change").when(F.col("c_custkey") % 5 == 0, "active").when(F.col("c_custkey") % 3 == 0, "profile").alias("signal"),
        (F.col("c_acctbal") > 9000).alias("active"), (F.col("c_nationkey") == 3).alias("own"), (F.col("c_custkey") % 5).alias("completeness"), (F.col("c_mktsegment") == "MACHINERY").alias("executive"), (F.col("c_acctbal") < 0).alias("personal"), F.lit(0.0).alias("bonus"))
    best = S.ranked(S.follow_up_scores(S.candidates(rows)), "score_total", "id", 200)
    return best.select(F.col("rank").cast("long").alias("rank"), "id", "score_interaction", "score_total")


FOLLOWUP_RANK = f"""WITH {_ACT}, r AS (SELECT c_custkey AS id, last_date, {_GAP} AS gap, coalesce(interactions, 0) AS n, CASE WHEN c_custkey % 11 = 0 THEN 30.0 WHEN c_custkey % 5 = 0 THEN 10.0 WHEN c_custkey % 3 = 0 THEN 3.0 ELSE 0 END::DOUBLE AS sig,
 c_custkey % 11 = 0 OR c_acctbal > 9000 AS free, c_custkey % 5 AS comp, c_mktsegment = 'MACHINERY' AS ex, c_acctbal < 0 AS pers FROM customer LEFT JOIN a ON id = c_custkey WHERE c_nationkey <> 3),
s AS (SELECT id, round(n * least(coalesce(gap, 0), 24.0::DOUBLE), 1) AS score_interaction,
 round((n * least(coalesce(gap, 0), 24.0::DOUBLE) + sig + comp * 2.0::DOUBLE + CASE WHEN ex THEN 15 ELSE 0 END) * CASE WHEN pers THEN 0.3::DOUBLE ELSE 1 END, 1) AS score_total
 FROM r WHERE free OR (last_date IS NOT NULL AND gap >= 6 AND gap <= 60 AND n >= 1))
SELECT row_number() OVER (ORDER BY score_total DESC, id) AS rank, * FROM s QUALIFY rank <= 200"""


def reconnect_rank(spark, sf):
    r = S.reconnect(order_activity(spark, sf), TODAY, months=3)
    return r.select(F.col("rank").cast("long").alias("rank"), "id", "interactions", "score")


RECONNECT_RANK = f"""WITH {_ACT} SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, interactions, score FROM (SELECT id, interactions, round(interactions * {_GAP}, 1) AS score FROM a WHERE date_diff('day', last_date, DATE '{TODAY}') >= 90 AND interactions >= 2) QUALIFY rank <= 50"""


def activity_year_labels(spark, sf):
    c, a = table(spark, sf, "customer"), order_activity(spark, sf)
    return c.join(a, c.c_custkey == a.id, "left").groupBy(S.year_label(F.col("last_date"), TODAY).alias("label")).agg(F.count(F.lit(1)).alias("n"))


ACTIVITY_YEAR_LABELS = f"WITH {_ACT} SELECT CASE WHEN last_date IS NULL THEN 'never' ELSE least(year(last_date), 2001)::VARCHAR END AS label, count(*) AS n FROM customer LEFT JOIN a ON id = c_custkey GROUP BY 1"


def _cards(spark, sf):
    c = table(spark, sf, "customer")
    stage = F.when(F.col("c_mktsegment") == "BUILDING", "contacted").when(F.col("c_mktsegment") == "MACHINERY", "won").otherwise("inbox")
    return c.select(F.col("c_custkey").alias("id"), stage.alias("stage"), F.col("c_acctbal").alias("score"))


_CARDS = "k AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'contacted' WHEN 'MACHINERY' THEN 'won' ELSE 'inbox' END AS stage, c_acctbal AS score FROM customer)"


def inbox_cap(spark, sf):
    return S.stage_counts(S.inbox_cap(_cards(spark, sf)))


INBOX_CAP = f"""WITH {_CARDS}, q AS (SELECT * FROM k QUALIFY stage <> 'inbox' OR row_number() OVER (PARTITION BY stage ORDER BY score DESC, id) <= 50)
SELECT s.stage, count(q.id) AS n FROM (VALUES {', '.join(f"('{s}')" for s in S.STAGES)}) s(stage) LEFT JOIN q ON q.stage = s.stage GROUP BY s.stage"""


def split_active(spark, sf):
    rows = _cards(spark, sf).withColumn("dismissed", F.col("stage") == "won")
    return S.split_active(rows).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


SPLIT_ACTIVE = f"""WITH {_CARDS}, r AS (SELECT *, row_number() OVER (PARTITION BY stage = 'won' ORDER BY score DESC, id) AS n FROM k)
SELECT CASE WHEN stage = 'won' THEN 'dismissed' WHEN n <= 100 THEN 'active' ELSE 'backlog' END AS bucket, count(*) AS n, min(score) AS low, max(score) AS high FROM r GROUP BY 1"""


_LEADS = [("CEO", "Tatra banka", "Legacy rebuild"), ("Director", "Acme", "Agentic tools"), ("Clerk", "Erste", ""), ("Owner", "", "Digital transformation and GPT"), ("", "Burza", "Vice president")]


def lead_signal_counts(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _LEADS)), (F.col("p_partkey") % len(_LEADS) + 1).cast("int"))
    tags = S.lead_signals(F.col("p_size") > 40, pick(0), pick(1), pick(2), F.lit(""), F.when(F.col("p_partkey") % 3 == 0, "mine").otherwise("theirs"))
    return p.select(F.explode(tags).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


LEAD_SIGNAL_COUNTS = f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_LEADS))}) t(k, title, org, headline)),
r AS (SELECT p_size > 40 AS moved, {_has("concat_ws(' ', title, headline, '')", S.TOP_EXECUTIVE)} AS top, {_has("concat_ws(' ', title, headline, '')", S.EXECUTIVE)} AS ex,
 {_has("concat_ws(' ', org, headline)", S.BANKING)} AS bank, {_has("concat_ws(' ', title, headline, '')", S.MODERNISATION)} AS it, {_has("headline", S.AGENTIC)} AS ag, p_partkey % 3 = 0 AS waits FROM part JOIN v ON k = p_partkey % {len(_LEADS)}),
c AS (SELECT count(*) FILTER (moved) AS recent_job_change, count(*) FILTER (top AND moved) AS promoted_ceo, count(*) FILTER (NOT top AND ex AND moved) AS new_c_level, count(*) FILTER ((top OR ex) AND NOT moved) AS exec_title,
 count(*) FILTER (bank) AS bank_finance, count(*) FILTER (it) AS it_modernisation, count(*) FILTER (ag) AS vibecoding_agentic, count(*) FILTER (waits) AS dm_awaiting_reply FROM r)
SELECT signal, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME signal VALUE n) WHERE n > 0"""


def crm_merge(spark, sf):
    a = order_activity(spark, sf)
    scores = a.where("orders > 5").select("id", F.concat(F.lit("c"), "id").alias("name"), F.col("orders").cast("double").alias("score"))
    return S.merge_crm(scores, _cards(spark, sf).where("id % 3 > 0").select("id", "stage"))


CRM_MERGE = f"""WITH {_ACT}, {_CARDS}, s AS (SELECT id, concat('c', id) AS name, orders::DOUBLE AS score FROM a WHERE orders > 5), t AS (SELECT id, stage FROM k WHERE id % 3 > 0)
SELECT id, name, score, coalesce(stage, 'inbox') AS stage FROM s LEFT JOIN t USING (id) UNION ALL SELECT id, id::VARCHAR, 0.0, stage FROM t WHERE stage <> 'inbox' AND id NOT IN (SELECT id FROM s)"""


def monthly_partition_counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("contacts"))


MONTHLY_PARTITION_COUNTS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS contacts FROM orders GROUP BY 1"

QUERIES = {
    "followup_rank": (followup_rank, FOLLOWUP_RANK),
    "reconnect_rank": (reconnect_rank, RECONNECT_RANK),
    "activity_year_labels": (activity_year_labels, ACTIVITY_YEAR_LABELS),
    "inbox_cap": (inbox_cap, INBOX_CAP),
    "split_active": (split_active, SPLIT_ACTIVE),
    "lead_signal_counts": (lead_signal_counts, LEAD_SIGNAL_COUNTS),
    "crm_merge": (crm_merge, CRM_MERGE),
    "monthly_partition_counts": (monthly_partition_counts, MONTHLY_PARTITION_COUNTS),
}
