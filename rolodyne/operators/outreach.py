"""Profiles, targets and outreach: what to scan, what changed, what to sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, text

#: Marks of a headline, of a job change, and of addresses that lost their accents.
ROLE_MARKS = [" at ", " @ ", "ceo", "cto", "founder", "director", "manager", "engineer", "developer", "consultant"]
CHANGE_MARKS = ["started a new position", "new role", "joined", "promoted to", "now working"]
BROKEN = ["%C4%", "%C5%", "%C3%", "/pub/"]
STATUSES = ["CONNECTED", "PENDING", "CREATOR_MODE", "DM_SENT", "DM_SKIPPED", "RESPONDED"]


def _any(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike("|".join(f"\\Q{w}\\E" for w in words))


def profile_signals(page: Column) -> Column:
    """struct(headline, job_change, recent_posts) from a profile page's text: the
    first of 20 lines with a role's mark (under 200 characters), the first line
    that tells of a change (150 characters of it), and up to three posts of 21 to
    299 characters after the heading of recent activity."""
    lines = F.filter(F.transform(F.split(F.trim(text(page)), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def parse(ls: Column) -> Column:
        first = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(1)), F.lit(""))
        heads = F.filter(F.slice(ls, 1, 20), lambda x: _any(x, ROLE_MARKS) & (F.length(x) < 200))
        changes = F.filter(ls, lambda x: _any(x, CHANGE_MARKS))
        title = lambda x: F.lower(x).contains("activity") & F.lower(x).contains("recent")
        at = F.array_position(F.transform(ls, title), True)
        posts = F.filter(ls, lambda x, i: (at > 0) & (i >= at) & ~title(x) & F.length(x).between(21, 299))
        return F.struct(first(heads).alias("headline"), F.left(first(changes), F.lit(150)).alias("job_change"), F.slice(posts, 1, 3).alias("recent_posts"))

    return let(lines, parse)


def classify_profile(known_org: Column, company: Column, activity: Column, headline: Column) -> Column:
    """struct(signal_type, signal_text): a job change where neither organisation's
    name holds the other, else activity, else the headline, else nothing."""
    plain = lambda c: F.regexp_replace(F.trim(F.lower(text(c))), r"\.+$", "")
    old, new = plain(known_org), plain(company)
    moved = (old != "") & (new != "") & ~old.contains(new) & ~new.contains(old)
    active = (text(activity) != "") & ~F.replace(F.lower(text(activity)), F.lit("_"), F.lit(" ")).contains("no recent posts")
    kind = F.when(moved, "job_change").when(active, "active").when(text(headline) != "", "profile").otherwise("no_activity")
    said = F.when(moved, F.concat(text(known_org), F.lit(" → "), text(company))).when(active, activity).when(text(headline) != "", headline).otherwise("No recent public activity")
    return F.struct(kind.alias("signal_type"), said.alias("signal_text"))


def is_broken(url: Column) -> Column:
    return F.coalesce(url.rlike("|".join(f"\\Q{b}\\E" for b in BROKEN)), F.lit(False))


def pending(targets: DataFrame, scanned: DataFrame) -> DataFrame:
    """Targets with a sound address that haven't been scanned."""
    return targets.where((text("url") != "") & ~is_broken(F.col("url"))).join(scanned.select("resource_name"), "resource_name", "left_anti")


def select_targets(reconnect: DataFrame, holders: DataFrame, scans: DataFrame, as_of: str, days: int = 7, cap: int = 20) -> DataFrame:
    """Those to reconnect with first (by score), then the other holders of a
    profile address; not those scanned in the last days; each once."""
    fresh = scans.where(F.datediff(F.lit(as_of).cast("date"), F.to_date("scanned_at")) < days).select("resource_name")
    both = reconnect.select("resource_name", F.lit(0).alias("source"), "score").unionByName(holders.select("resource_name", F.lit(1).alias("source"), F.lit(0.0).alias("score")))
    once = both.groupBy("resource_name").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("k"))
    return once.join(fresh, "resource_name", "left_anti").orderBy("k", "resource_name").limit(cap).select("resource_name", F.col("k.source").alias("source"))


def rescan_due(last_seen: Column, as_of: str, days: int = 7) -> Column:
    """Never seen, or longer ago than that."""
    return last_seen.isNull() | (F.datediff(F.lit(as_of).cast("date"), last_seen) >= days)


def drop_mass_meetings(cache: DataFrame, mass: Column) -> DataFrame:
    """cache (email, last_email struct, last_meeting struct(date, title)): meetings
    of mass events, or without a title, count as none."""
    bad = (text(F.col("last_meeting.title")) == "") | mass
    return cache.withColumn("last_meeting", F.when(~F.coalesce(bad, F.lit(True)), F.col("last_meeting")))


def changed_notes(now: DataFrame, noted: DataFrame) -> DataFrame:
    """Rows (resource_name, email_date, meeting_date) whose pair differs from what was noted last."""
    n = noted.select("resource_name", F.struct("email_date", "meeting_date").alias("_noted"))
    return now.join(n, "resource_name", "left").where(~F.struct("email_date", "meeting_date").eqNullSafe(F.col("_noted"))).drop("_noted")


def with_context(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows where any of the columns says something."""
    return rows.where(F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns)).isNotNull())


def sync_candidates(rows: DataFrame, own: Column, default_stage: str = "inbox") -> DataFrame:
    """rows (resource_name, notes, stage, synced_notes, synced_stage): what has
    notes or a stage of its own that isn't synced yet; no legacy ids, no own colleagues."""
    notes = (F.trim(text("notes")) != "") & ~F.col("notes").eqNullSafe(F.col("synced_notes"))
    stage = (text("stage") != "") & (F.col("stage") != default_stage) & ~F.col("stage").eqNullSafe(F.col("synced_stage"))
    return rows.where(F.col("resource_name").startswith("people/c") & ~own & (notes | stage))


def checked_update(rows: DataFrame, stages: list[str], longest: int = 5000) -> DataFrame:
    """rows (id, stage, notes, medium, high) with an array of what is wrong with each."""
    wrong = F.array_compact(
        F.array(
            F.when(~text("id").rlike(r"^people/[A-Za-z0-9_-]+$"), "id"),
            F.when(F.col("stage").isNotNull() & ~F.col("stage").isin(stages), "stage"),
            F.when(F.length(text("notes")) > longest, "notes"),
            F.when(~F.coalesce(F.col("medium").between(0, 1) & F.col("high").between(0, 1) & (F.col("medium") < F.col("high")), F.lit(True)), "thresholds"),
        )
    )
    return rows.withColumn("errors", wrong)


def log_message(log: DataFrame, entries: DataFrame, days: int = 7) -> DataFrame:
    """Adds messages (contact, at, text) to a log, each with its day to follow up."""
    return log.unionByName(entries.select("contact", "at", "text", F.date_add(F.to_date("at"), days).alias("follow_up")))


def message_stats(log: DataFrame, as_of: str) -> DataFrame:
    """log (status, follow_up): sent, skipped, share answered, follow-ups due."""
    sent = F.count_if(F.col("status").isin("DM_SENT", "RESPONDED"))
    return log.agg(sent.alias("sent"), F.count_if(F.col("status") == "DM_SKIPPED").alias("skipped"), F.round(F.try_divide(F.lit(100) * F.count_if(F.col("status") == "RESPONDED"), sent), 0).alias("answered_percent"), F.count_if((F.col("status") == "DM_SENT") & (F.col("follow_up") <= F.lit(as_of).cast("date"))).alias("due"))


def outreach_stats(contacts: DataFrame, runs: DataFrame, snapshots: DataFrame, acceptance: float = 0.88) -> DataFrame:
    """Counts by status, the latest number of followers and all deltas, and the
    accepted share of what was sent; the acceptance factor is a parameter."""
    c = contacts.agg(F.count(F.lit(1)).alias("contacts"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))
    r = runs.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"))
    s = snapshots.agg(F.max_by("followers", "at").alias("followers"), F.coalesce(F.sum("delta"), F.lit(0)).alias("follower_delta"))
    both = c.crossJoin(r).crossJoin(s)  # one row each
    return both.withColumn("acceptance_percent", F.when(F.col("sent") > 0, F.round(100 * F.round(F.col("sent") * acceptance) / F.col("sent"))))


def with_delta(snapshots: DataFrame) -> DataFrame:
    """snapshots (account, at, followers) with the difference to the one before."""
    return snapshots.withColumn("delta", F.col("followers") - F.lag("followers").over(Window.partitionBy("account").orderBy("at")))


def display_names(ids: DataFrame, plan: DataFrame, signals: DataFrame) -> DataFrame:
    """The plan's name of an id, else the signals', else the id."""
    p = plan.groupBy("id").agg(F.min("name").alias("p"))
    s = signals.groupBy("id").agg(F.min("name").alias("s"))
    return ids.join(p, "id", "left").join(s, "id", "left").select("id", F.coalesce(F.nullif("p", F.lit("")), F.nullif("s", F.lit("")), F.col("id")).alias("name"))


def filter_rows(rows: DataFrame, needle: str | None = None, fields: tuple[str, ...] = ("name",), equal: dict[str, str] | None = None, begins: dict[str, str] | None = None, holds: dict[str, str] | None = None, present: dict[str, bool] | None = None) -> DataFrame:
    """The filters of a list, those given: a text in any of the fields (whatever its
    case; null fields hold nothing), columns equal to a value or beginning with
    one, arrays that hold a value, columns that are there or not. A value of 'all'
    or an empty one filters nothing."""
    some = lambda given: [(c, v) for c, v in (given or {}).items() if v not in (None, "", "all", "__all__")]
    if needle and needle.strip():
        found = F.lit(False)
        for c in fields:
            found = found | F.contains(F.lower(text(c)), F.lit(needle.lower()))
        rows = rows.where(found)
    for c, v in some(equal):
        rows = rows.where(F.col(c) == v)
    for c, v in some(begins):
        rows = rows.where(F.col(c).startswith(v))
    for c, v in some(holds):
        rows = rows.where(F.array_contains(c, v))
    for c, v in (present or {}).items():
        rows = rows.where(F.col(c).isNotNull() if v else F.col(c).isNull())
    return rows


def undecided(changes: DataFrame, decisions: DataFrame, key: str = "change_id") -> DataFrame:
    """Changes without a decision."""
    return changes.join(decisions.select(key).distinct(), key, "left_anti")


def sort_rows(rows: DataFrame, by: str, kinds: list[str] | None = None) -> DataFrame:
    """By name, gap, date, or a list's order of kinds."""
    if by == "type":
        place = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("signal_type")), F.lit(0))
        return rows.orderBy(F.when(place == 0, len(kinds) + 1).otherwise(place), F.lower("name"))
    return rows.orderBy({"name": F.lower("name"), "gap": F.desc("months_gap"), "date": F.desc("last_date")}[by], "id")
