"""Follow-up and reconnect ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of executive titles and of personal mail domains; callers may replace them.
EXECUTIVE = ["ceo", "cto", "cfo", "coo", "cmo", "cpo", "ciso", "cro", "founder", "co-founder", "cofounder", "owner", "president", "managing director", "managing partner", "partner", "head of", "vp ", "vice president", "director", "zakladatel", "majitel", "spolumajitel", "riaditel", "konatel"]
PERSONAL_DOMAINS = ["gmail.com", "hotmail.com", "yahoo.com", "icloud.com", "me.com", "zoznam.sk", "azet.sk", "pobox.sk", "centrum.sk", "centrum.cz", "seznam.cz", "post.cz", "email.cz"]
#: Words that tell a lead's kind.
TOP_EXECUTIVE = ["ceo", "chief executive", "founder", "owner", "president", "majitel", "zakladatel"]
BANKING = ["bank", "banka", "poistovna", "poistovňa", "insurance", "sporiteln", "slsp", "vub", "vúb", "pps", "unicredit", "tatra", "csob", "čsob", "kb ", "komercni", "komerční", "raiffeisen", "intesa", "erste", "finance", "financ", "bcpb", "burza", "capital"]
MODERNISATION = ["ai transformation", "ai-transformation", "modernis", "legacy", "rebuild", "replatform", "re-platform", "digital transformation", "cloud migration"]
AGENTIC = ["cursor", "copilot", "agentic", "vibecoding", "vibe coding", "claude", "gpt", "llm"]
WEIGHTS = {"job_change": 30.0, "active": 10.0, "profile": 3.0, "no_activity": 0.0, "completeness": 2.0, "executive": 15.0, "personal": 0.3, "gap_cap": 24.0, "headline": 15, "min_months": 6, "min_interactions": 1, "max_months": 60, "top": 200}
STAGES = ["inbox", "contacted", "in_progress", "meeting", "proposal", "won", "lost", "archived"]


def months_gap(last: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), last) / F.lit(30.0)


def is_executive(*texts: Column, marks: list[str] = EXECUTIVE) -> Column:
    hay = F.lower(F.concat_ws(" ", *texts))
    return hay.rlike("|".join(f"\\Q{m}\\E" for m in marks))


def likely_personal(has_org: Column, has_profile: Column, title: Column, emails: Column, domains: list[str] = PERSONAL_DOMAINS) -> Column:
    """No company, profile or title, and no mail address outside personal domains."""
    found = F.transform(F.filter(emails, lambda e: e.contains("@")), lambda e: F.lower(F.element_at(F.split(e, "@"), -1)))
    only = (F.size(found) > 0) & F.forall(found, lambda d: d.isin(domains))
    return ~has_org & ~has_profile & (F.coalesce(title, F.lit("")) == "") & ((F.size(emails) == 0) | only)


def own_company(org: Column, emails: Column, words: list[str], domains: list[str]) -> Column:
    named = F.lower(F.coalesce(org, F.lit(""))).rlike("|".join(f"\\Q{w}\\E" for w in words)) if words else F.lit(False)
    return named | F.exists(emails, lambda e: F.lower(F.element_at(F.split(e, "@"), -1)).isin(domains))


def signal_type(kind: Column, headline: Column, shortest: int = WEIGHTS["headline"]) -> Column:
    """A job change with a short headline counts as a profile only."""
    return F.when((kind == "job_change") & (F.length(F.trim(F.coalesce(headline, F.lit("")))) < shortest), F.lit("profile")).otherwise(kind)


def completeness(*present: Column) -> Column:
    return sum((p.cast("int") for p in present), F.lit(0))


def candidates(rows: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """rows: name, last_date, months_gap, interactions, signal, active, own.
    Job changes and live activity pass the limits on gap and count; rows without
    a date need one of them; nameless rows and own colleagues go."""
    free = F.coalesce((F.col("signal") == "job_change") | F.col("active"), F.lit(False))
    gap, dated = F.col("months_gap"), F.col("last_date").isNotNull()
    within = dated & (gap >= weights["min_months"]) & (gap <= weights["max_months"]) & (F.col("interactions") >= weights["min_interactions"])
    return rows.where((F.coalesce("name", F.lit("")) != "") & ~F.col("own") & (free | within))


def follow_up_scores(rows: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Adds the score's components and score_total."""
    w = weights
    signal = F.lit(0.0)
    for kind in ("job_change", "active", "profile", "no_activity"):
        signal = F.when(F.col("signal") == kind, F.lit(w[kind])).otherwise(signal)
    gap = F.least(F.coalesce("months_gap", F.lit(0.0)), F.lit(w["gap_cap"]))
    out = rows.withColumns(
        {
            "score_interaction": F.col("interactions") * gap,
            "score_signal": signal,
            "score_completeness": F.col("completeness") * F.lit(w["completeness"]),
            "score_executive": F.when(F.col("executive"), F.lit(w["executive"])).otherwise(F.lit(0.0)),
            "multiplier": F.when(F.col("personal"), F.lit(w["personal"])).otherwise(F.lit(1.0)),
        }
    )
    parts = F.col("score_interaction") + F.col("score_signal") + F.col("score_completeness") + F.col("score_executive") + F.coalesce("bonus", F.lit(0.0))
    return out.withColumn("score_total", F.round(parts * F.col("multiplier"), 1)).withColumn("score_interaction", F.round("score_interaction", 1))


def ranked(rows: DataFrame, score: str, tie: str, top: int) -> DataFrame:
    """The top rows with rank from 1: a top-k first, then a rank over k rows."""
    best = rows.orderBy(F.desc(score), tie).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def last_activity(emails: DataFrame, cache: DataFrame) -> DataFrame:
    """emails (id, email), cache (email, email_date, meeting_date) -> per id the
    latest date and how many kinds of contact there were (0 to 2)."""
    j = emails.join(cache, "email")
    has = lambda c: F.max((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int"))
    return j.groupBy("id").agg(F.greatest(F.max("email_date"), F.max("meeting_date")).alias("last_date"), (has("email_date") + has("meeting_date")).alias("interactions"))


def all_mail_count(emails: DataFrame, cache: DataFrame) -> DataFrame:
    """The other count: every address with mail and every one with a meeting."""
    j = emails.join(cache, "email")
    one = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return j.groupBy("id").agg(F.greatest(F.max("email_date"), F.max("meeting_date")).alias("last_date"), (one("email_date") + one("meeting_date")).alias("interactions"))


def score_contacts(contacts: DataFrame, cache: DataFrame, signals: DataFrame, kpis: DataFrame, as_of: str, own_words: list[str] | None = None, own_domains: list[str] | None = None, weights: dict = WEIGHTS) -> DataFrame:
    """The follow-up ranking from its sources: contacts (id, name, emails array,
    has_phone, org, title, profile_url), cache (email, email_date, meeting_date),
    signals (id, signal_type, headline, current_role), kpis (id, bonus, active_30d).
    Whoever has activity in the cache or the indicators is looked at; each source
    joins on its key, and the top rows are ranked."""
    mails = contacts.select("id", F.explode("emails").alias("e")).select("id", F.lower(F.trim("e")).alias("email")).distinct()
    seen = last_activity(mails, cache)
    s = signals.select("id", signal_type(F.col("signal_type"), F.col("headline")).alias("signal"), "headline", "current_role", F.lit(True).alias("has_signal"))
    everyone = seen.select("id").union(kpis.select("id")).distinct()
    j = contacts.join(everyone, "id", "left_semi").join(seen, "id", "left").join(s, "id", "left").join(kpis.select("id", "bonus", "active_30d"), "id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    has_org, has_profile = blank("org") != "", (blank("profile_url") != "") | F.coalesce("has_signal", F.lit(False))
    rows = j.select(
        "id",
        "name",
        "last_date",
        months_gap(F.col("last_date").cast("date"), as_of).alias("months_gap"),
        F.coalesce("interactions", F.lit(0)).alias("interactions"),
        "signal",
        (F.coalesce("active_30d", F.lit(0)) > 0).alias("active"),
        own_company(F.col("org"), F.col("emails"), own_words or [], own_domains or []).alias("own"),
        completeness(F.size("emails") > 0, F.coalesce("has_phone", F.lit(False)), has_org, has_profile).alias("completeness"),
        is_executive(blank("title"), blank("headline"), blank("current_role")).alias("executive"),
        likely_personal(has_org, has_profile, F.col("title"), F.col("emails")).alias("personal"),
        F.coalesce("bonus", F.lit(0.0)).alias("bonus"),
    )
    return ranked(follow_up_scores(candidates(rows, weights), weights), "score_total", "id", weights["top"])


def reconnect(rows: DataFrame, as_of: str, top: int = 50, months: int = 12, least: int = 2) -> DataFrame:
    """rows: id, last_date, interactions; score is interactions times the gap."""
    gap = months_gap(F.col("last_date"), as_of)
    old = rows.where((F.datediff(F.lit(as_of).cast("date"), "last_date") >= months * 30) & (F.col("interactions") >= least))
    return ranked(old.withColumn("score", F.round(F.col("interactions") * gap, 1)), "score", "id", top)


def year_label(last: Column, as_of: str) -> Column:
    """Year of the last activity, not beyond the current one; never if none."""
    return F.when(last.isNull(), F.lit("never")).otherwise(F.least(F.year(last), F.year(F.lit(as_of).cast("date"))).cast("string"))


def signal_counts(signals: DataFrame, kinds: tuple[str, ...] = ("job_change", "active", "profile", "no_activity")) -> DataFrame:
    """(signal_type, n) for every kind, those without any as zero; others as 'other'."""
    kind = F.when(F.col("signal_type").isin(list(kinds)), F.col("signal_type")).otherwise("other")
    n = signals.groupBy(kind.alias("signal_type")).agg(F.count(F.lit(1)).alias("n"))
    every = signals.sparkSession.createDataFrame([(k,) for k in kinds], "signal_type string")
    return every.join(n, "signal_type", "full_outer").select("signal_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def score_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("signal") == s).alias(s) for s in ("job_change", "active", "profile", "no_activity")),
        F.round(F.avg("completeness"), 1).alias("avg_completeness"),
        F.count_if(F.coalesce("bonus", F.lit(0.0)) != 0).alias("enriched"),
        F.round(F.avg("bonus"), 1).alias("avg_bonus"),
    )


def mentions(c: Column, words: list[str]) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(f"\\Q{w}\\E" for w in words))


def lead_signals(job_change: Column, title: Column, org: Column, headline: Column, role: Column, awaiting: Column) -> Column:
    """Up to eight tags, in this order, each once: a job change (with a top or
    another executive role: promoted or new), an executive title, banking and
    finance, modernisation, agentic work, a message that waits for an answer."""
    spaced = lambda *cs: F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in cs))
    roles, companies = spaced(title, headline, role), spaced(org, headline)
    moved = F.coalesce(job_change, F.lit(False))
    top, executive = mentions(roles, TOP_EXECUTIVE), mentions(roles, EXECUTIVE)
    tags = [
        ("recent_job_change", moved),
        ("promoted_ceo", top & moved),
        ("new_c_level", ~top & executive & moved),
        ("exec_title", (top | executive) & ~moved),
        ("bank_finance", mentions(companies, BANKING)),
        ("it_modernisation", mentions(roles, MODERNISATION)),
        ("vibecoding_agentic", mentions(headline, AGENTIC)),
        ("dm_awaiting_reply", F.coalesce(awaiting == "mine", F.lit(False))),
    ]
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in tags))))


def inbox_cap(cards: DataFrame, cap: int = 50) -> DataFrame:
    """cards: id, stage, score. Of the inbox only the `cap` best stay."""
    box = cards.where(F.col("stage") == "inbox").orderBy(F.desc("score"), "id").limit(cap)
    return box.unionByName(cards.where(F.coalesce(F.col("stage") != "inbox", F.lit(True))))


def stage_counts(cards: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """Every stage, also those without cards."""
    spark = cards.sparkSession
    every = spark.createDataFrame([(s,) for s in stages], "stage string")
    n = cards.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def split_active(rows: DataFrame, cap: int = 100) -> DataFrame:
    """rows: id, score, dismissed -> bucket: dismissed, active (the first `cap`) or backlog."""
    top = rows.where(~F.col("dismissed")).orderBy(F.desc("score"), "id").limit(cap).select("id", F.lit(True).alias("in_top"))
    return rows.join(top, "id", "left").withColumn("bucket", F.when(F.col("dismissed"), "dismissed").when(F.col("in_top"), "active").otherwise("backlog")).drop("in_top")


def merge_crm(scores: DataFrame, state: DataFrame) -> DataFrame:
    """scores (id, name, score) with state (id, stage); ids only the state knows
    come too unless their stage is the inbox."""
    both = scores.join(state, "id", "left").select("id", "name", "score", F.coalesce("stage", F.lit("inbox")).alias("stage"))
    only = state.where(F.col("stage") != "inbox").join(scores, "id", "left_anti").select("id", F.col("id").cast("string").alias("name"), F.lit(0.0).alias("score"), "stage")
    return both.unionByName(only)


def upsert_stage(state: DataFrame, updates: DataFrame, always_stamp: bool = False) -> DataFrame:
    """state (id, stage, changed_at), updates (id, stage, at): a new stamp only on
    a real change, unless always_stamp."""
    u = updates.select("id", F.col("stage").alias("new_stage"), F.col("at"))
    j = state.join(u, "id", "full_outer")
    moved = F.col("new_stage").isNotNull() & (F.lit(always_stamp) | ~F.col("new_stage").eqNullSafe(F.col("stage")))
    return j.select("id", F.coalesce("new_stage", "stage").alias("stage"), F.when(moved, F.col("at")).otherwise(F.col("changed_at")).alias("changed_at"))
