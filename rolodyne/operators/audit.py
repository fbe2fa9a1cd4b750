"""Change log: summaries, pages, rollback, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import global_rank


def band(confidence: Column, high: float = 0.90, medium: float = 0.60) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def contact_stats(changes: DataFrame, by: str = "resource_name") -> DataFrame:
    b = band(F.col("confidence"))
    return changes.groupBy(by).agg(*(F.count_if(b == x).alias(x) for x in ("high", "medium", "low")), F.count(F.lit(1)).alias("total"))


def run_summary(changes: DataFrame, kind: str = "category") -> DataFrame:
    """Counts by band and by kind in one pass: (dimension, value, n)."""
    b = changes.select(band(F.col("confidence")).alias("band"), F.col(kind).alias("kind"))
    out = b.groupingSets([["band"], ["kind"], []], "band", "kind").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("g") == 1, "band").when(F.col("g") == 2, "kind").otherwise("all").alias("dimension"), F.coalesce("band", "kind", F.lit("all")).alias("value"), "n")


def field_category(path: Column) -> Column:
    """First part of a field path, as one of a fixed list."""
    base = F.regexp_extract(F.coalesce(path, F.lit("")), r"^([A-Za-z]+)", 1)
    known = ["names", "phoneNumbers", "emailAddresses", "addresses", "organizations", "urls", "birthdays", "events", "userDefined"]
    return F.when(base.isin(known), base).otherwise(F.lit("other"))


#: Categories of reasons; the first pattern that matches counts.
CATEGORIES = [
    ("diacritics_given", r"diacritics.*given"),
    ("diacritics_family", r"diacritics.*family"),
    ("diacritics", r"diacritics"),
    ("org_case", r"organization|letter casing \(org"),
    ("title_case", r"letter casing|Title Case"),
    ("phone_format", r"phone.*normalization|international format"),
    ("phone_type", r"phone.*type"),
    ("phone_duplicate", r"duplicate phone"),
    ("email_normalize", r"email.*normalization|email.*lowercase"),
    ("email_invalid", r"invalid.*email"),
    ("email_duplicate", r"duplicate email"),
    ("address_zip", r"postal code"),
    ("address_country", r"country"),
    ("address_parse", r"address.*pars"),
    ("name_extract", r"name.*extract|inferred.*name"),
    ("name_split", r"name.*split|split.*name"),
    ("name_title", r"title.*extract|prefix.*extract"),
    ("company_in_name", r"company.*name|company_in_name"),
    ("family_name_fix", r"family.*name|familyName"),
    ("x500_dn", r"X\.500 DN"),
    ("org_from_email", r"inferred from email|organization.*email"),
    ("phone_from_note", r"phone.*(?:found in|from) notes|phone.*extracted from notes"),
    ("email_from_note", r"email.*(?:found in|from) notes|email.*extracted from notes"),
    ("url_from_note", r"(?:URL|url|website).*(?:found in|from) notes|URL.*extracted from notes"),
    ("event_from_note", r"(?:birthday|anniversary|date|event).*(?:found in|from) notes|(?:from|extracted from) notes"),
    ("owner_email", r"owner email"),
    ("corporate_url", r"corporate.*(?:LinkedIn|website|directory|social media)"),
    ("shared_address", r"shared HQ|shared.*office.*address"),
    ("tobedeleted", r"low-value contact|deletion candidate"),
]


def rule_category(reason: Column, table: list[tuple[str, str]] = CATEGORIES) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(table):
        out = F.when(F.coalesce(reason, F.lit("")).rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key, whole."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def keep_last(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key by the given (descending) order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def repeated_within(rows: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Flags the second and later rows of a value within a group."""
    nth = F.row_number().over(Window.partitionBy(*group, value).orderBy(*order))
    return rows.withColumn("is_duplicate", nth > 1)


def suppress_round_trips(changes: DataFrame) -> DataFrame:
    """Drops all changes of a (resource_name, field) whose two or more changes
    end where they began."""
    w = Window.partitionBy("resource_name", "field")
    marked = changes.withColumns({"_n": F.count(F.lit(1)).over(w), "_first": F.min_by("old", "seq").over(w), "_last": F.max_by("new", "seq").over(w)})
    return marked.where(~((F.col("_n") > 1) & F.col("_first").eqNullSafe(F.col("_last")))).drop("_n", "_first", "_last")


def rollback_state(changes: DataFrame) -> DataFrame:
    """Per (resource_name, field) the value before the first change."""
    return changes.groupBy("resource_name", "field").agg(F.min_by("old", "seq").alias("restore"), F.max_by("new", "seq").alias("current"), F.count(F.lit(1)).alias("undone"))


def rollback_entries(changes: DataFrame) -> DataFrame:
    """The changes in reverse, old and new swapped."""
    return changes.select("resource_name", "field", F.col("new").alias("old"), F.col("old").alias("new"), F.row_number().over(Window.partitionBy("resource_name").orderBy(F.desc("seq"))).alias("step"))


def log_summary(log: DataFrame) -> DataFrame:
    """log: type (null for changes), resource_name, confidence, batch, success,
    failed, at. Of a batch's end markers the last counts."""
    changes = log.where("type is null").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("resource_name").alias("contacts"), *(F.count_if(band(F.col("confidence")) == b).alias(b) for b in ("high", "medium", "low")))
    ends = log.where("type = 'batch_end'").groupBy("batch").agg(F.max_by(F.struct("success", "failed"), "at").alias("m"))
    return changes.crossJoin(ends.agg(F.coalesce(F.sum("m.success"), F.lit(0)).alias("success"), F.coalesce(F.sum("m.failed"), F.lit(0)).alias("failed")))  # one row each


def top_per_group(rows: DataFrame, group: str, item: str, n: int = 10) -> DataFrame:
    """The n most frequent items of each group with counts; ties by name."""
    counts = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counts.withColumn("position", nth).where(F.col("position") <= n)


def daily_runs(log: DataFrame, at: str = "at") -> DataFrame:
    return log.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("resource_name").alias("contacts"))


def latest_day(log: DataFrame, at: str = "at") -> DataFrame:
    """Totals of the last day: the day is one value, then the scan is filtered by it."""
    day = log.agg(F.max(F.to_date(at)).alias("last_day"))
    return log.join(F.broadcast(day), F.to_date(at) == F.col("last_day")).groupBy("last_day").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("resource_name").alias("contacts"))


def page(rows: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """One page; number from 1, size between 5 and 50."""
    number, size = max(1, number), min(50, max(5, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def grouped_log(log: DataFrame, at: str = "at") -> DataFrame:
    """Per contact: entries newest first, their count, the latest instant."""
    return log.groupBy("resource_name").agg(F.count(F.lit(1)).alias("entries"), F.max(at).alias("latest"), F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "field", "old", "new")), asc=False).alias("changes"))


def search(log: DataFrame, needle: str | None = None, field: str | None = None, bands: list[str] | None = None, session: str | None = None) -> DataFrame:
    """Optional filters over a change log."""
    if needle:
        hay = F.lower(F.concat_ws(" ", "resource_name", "field", "old", "new", "reason"))
        log = log.where(hay.contains(needle.lower()))
    if field:
        log = log.where(F.col("field").startswith(field) | F.col("field").contains(field))
    if bands:
        log = log.where(band(F.col("confidence")).isin(bands))
    if session:
        log = log.where(F.col("session_id") == session)
    return log


def batches(rows: DataFrame, size: int = 50) -> DataFrame:
    """rows: resource_name, high, total -> with rank and batch from 1, the most
    certain first. Ranks come from ranges of the whole order, so contacts of equal
    figures spread over tasks like any others."""
    ranked = global_rank(rows, [F.desc("high"), F.desc("total"), F.col("resource_name")])
    return ranked.withColumn("batch", F.ceil(F.col("rank") / size).cast("long"))


def review_stats(changes: DataFrame, *by: str) -> DataFrame:
    """Of changes to be reviewed the number and the range of confidence, by kind
    (1 and 0 where none is known)."""
    c = changes.where(band(F.col("confidence")) == "medium")
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("confidence"), F.lit(1.0)).alias("low"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("high"))


def top_contacts(log: DataFrame, n: int = 10, at: str = "at", recent: bool = False) -> DataFrame:
    """The n contacts with the most changes, or the latest ones; ties by name."""
    per = log.groupBy("resource_name").agg(F.count(F.lit(1)).alias("changes"), F.max(at).alias("latest"))
    return per.orderBy(F.desc("latest" if recent else "changes"), "resource_name").limit(n)


def change_hash(changes: DataFrame) -> DataFrame:
    """Per contact a digest of its changes, whatever their order."""
    entry = F.to_json(F.struct("field", "old", "new", "reason"))
    return changes.groupBy("resource_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"))


def changed_since(changes: DataFrame, history: DataFrame) -> DataFrame:
    """Contacts whose medium changes differ from the last run's (resource_name, digest)."""
    now = change_hash(changes.where(band(F.col("confidence")) == "medium"))
    return now.join(history, ["resource_name", "digest"], "left_anti")


def verify_against(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Distinct changed contacts, and how many of them the snapshot lacks."""
    touched = log.select("resource_name").distinct()
    missing = touched.join(snapshot, "resource_name", "left_anti")
    return touched.agg(F.count(F.lit(1)).alias("changed")).crossJoin(missing.agg(F.count(F.lit(1)).alias("missing")))  # one row each
