"""Groups of contacts: statistics, membership differences, labels by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_stats(groups: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """Members of each group and how they spread over organisations."""
    n = members.groupBy("label").agg(F.countDistinct("contact").alias("members"))
    spread = members.join(orgs, "contact").groupBy("label", "org").agg(F.countDistinct("contact").alias("n"))
    spread = spread.groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("org", "n")))).alias("orgs"))
    return groups.join(n, "label", "left").join(spread, "label", "left").select("label", F.coalesce("members", F.lit(0)).alias("members"), "orgs").orderBy(F.desc("members"), "label")


def unlabelled(contacts: DataFrame, members: DataFrame) -> DataFrame:
    return contacts.join(members.select("contact").distinct(), "contact", "left_anti")


def additions(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(label, contact) still to be added."""
    return wanted.distinct().join(members, ["label", "contact"], "left_anti")


def key_union(*tables: DataFrame) -> DataFrame:
    """The distinct keys of all tables of one column."""
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out.distinct()


def known(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an index."""
    return rows.join(index.select(key).distinct(), key, "left_semi")


def union_lists(seed: DataFrame, fetched: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(value): seed, fetched and added together, less removed."""
    return seed.union(fetched).union(added).distinct().join(removed, "value", "left_anti")


def merge_maps(*tables: DataFrame) -> DataFrame:
    """(key, value): later tables win."""
    every = None
    for k, t in enumerate(tables):
        one = t.select("key", "value", F.lit(k).alias("o"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("key").agg(F.max_by("value", "o").alias("value"))
