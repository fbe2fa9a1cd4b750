"""Learning from reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, short_id

PRIOR, PRIOR_WEIGHT, LEAST, LOW, HIGH, FIXED = 0.75, 10.0, 5, 0.30, 0.98, 0.97


def change_id(resource: Column, field: Column, new: Column) -> Column:
    """Twelve hex digits of contact, field and new value; the old value doesn't count."""
    return short_id(resource, field, new, size=12)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each change."""
    return decisions.groupBy("change_id").agg(F.max_by("decision", "decided_at").alias("decision"), F.max("decided_at").alias("decided_at"))


def rule_stats(decided: DataFrame) -> DataFrame:
    """decided (category, decision: approved, rejected or edited) -> counts and the
    smoothed confidence; null below LEAST decisions."""
    s = decided.groupBy("category").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("approved", "rejected", "edited")))
    total = F.col("approved") + F.col("rejected") + F.col("edited")
    smooth = F.round((F.lit(PRIOR * PRIOR_WEIGHT) + F.col("approved") + F.col("edited")) / (F.lit(PRIOR_WEIGHT) + total), 3)
    return s.withColumn("total", total).withColumn("confidence", F.when(total >= LEAST, F.least(F.greatest(smooth, F.lit(LOW)), F.lit(HIGH))))


def approval_rate(decided: DataFrame) -> DataFrame:
    """(approved + edited) over all decided; null without decisions."""
    s = decided.groupBy("category").agg(F.count_if(F.col("decision").isin("approved", "edited")).alias("yes"), F.count_if(F.col("decision").isin("approved", "edited", "rejected")).alias("decided"))
    return s.select("category", "decided", F.round(F.try_divide(F.col("yes"), F.col("decided")), 4).alias("rate"))


def adjust(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """A category's learned confidence replaces a change's, unless that is FIXED or
    more; with fewer decisions, the two are blended by their number."""
    known = stats.select("category", F.col("confidence").alias("_learned"), "total", (F.col("approved") + F.col("edited")).alias("_yes"))
    few = (F.col("confidence") * PRIOR_WEIGHT + F.col("_yes")) / (F.lit(PRIOR_WEIGHT) + F.col("total"))
    out = changes.join(known, "category", "left")
    value = F.when(F.col("confidence") >= FIXED, F.col("confidence")).otherwise(F.coalesce("_learned", F.when(F.col("total") > 0, F.round(few, 3)), "confidence"))
    return out.withColumn("confidence", value).drop("_learned", "_yes", "total")


def without_rejected(changes: DataFrame, rejected: DataFrame) -> DataFrame:
    """Proposals a reviewer has turned down for that contact, field and value go."""
    return changes.join(rejected.select("resource_name", "field", "new"), ["resource_name", "field", "new"], "left_anti")


def join_decisions(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Decisions with what they were about; those without a change drop out."""
    keyed = changes.withColumn("change_id", change_id(F.col("resource_name"), F.col("field"), F.col("new")))
    return latest_decisions(decisions).join(keyed, "change_id")


def merge_stats(stats: DataFrame, renames: DataFrame) -> DataFrame:
    """stats (category, approved, rejected, edited), renames (prefix, target): the
    counts of categories with a prefix go to its target, the longest prefix first.
    A category meets the renames by equality with each of its beginnings."""
    begins = stats.select("category", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("category"), F.lit(1))), lambda n: F.left("category", n))).alias("prefix")).distinct()
    renamed = begins.join(renames, "prefix").groupBy("category").agg(F.max_by("target", F.length("prefix")).alias("target"))
    j = stats.join(renamed, "category", "left")
    return j.groupBy(F.coalesce("target", "category").alias("category")).agg(*(F.sum(c).alias(c) for c in ("approved", "rejected", "edited")))


def diacritics_preference(votes: DataFrame) -> DataFrame:
    """votes (original, corrected, approved): corrected where more approve than not."""
    v = votes.groupBy(F.lower(fold(F.col("original"))).alias("name"), "original", "corrected").agg(F.count_if("approved").alias("yes"), F.count_if(~F.col("approved")).alias("no"))
    return v.select("name", F.when(F.col("yes") > F.col("no"), F.col("corrected")).otherwise(F.col("original")).alias("preferred"))


def recent(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The last n rows of all."""
    return rows.orderBy(F.desc(by)).limit(n)


def evict(rejections: DataFrame, most: int = 500) -> DataFrame:
    """Keeps the rejections of the `most` contacts with the latest ones."""
    keep = rejections.groupBy("resource_name").agg(F.max("at").alias("_last")).orderBy(F.desc("_last"), "resource_name").limit(most).select("resource_name")
    return rejections.join(keep, "resource_name", "left_semi")


def merge_review(rules: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewer rows (field, old, new, confidence, reason) replace rule rows of the
    same contact and field; confidence 0 or less deletes; missing values fall
    back; of several rule rows of a field the last counts."""
    keys = ["resource_name", "field"]
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = rules.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    r = reviewed.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("old", "new", "confidence", "reason")))
    j = last.join(r, keys, "full_outer").where(F.coalesce("_confidence", "confidence", F.lit(0.0)) > 0)
    return j.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in ("old", "new", "confidence", "reason")))
