"""Reference tables, saved indicators and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def save_kpis(kpis: DataFrame, path: str, version: int = VERSION) -> None:
    kpis.withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_kpis(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """Saved indicators; another schema version is refused."""
    saved = spark.read.parquet(path)
    other = saved.where(~F.col("schema_version").eqNullSafe(F.lit(version)))
    if not other.isEmpty():
        raise ValueError(f"saved with another schema version than {version}")
    return saved.drop("schema_version")


def reference_values(spark: SparkSession, path: str, seed: list[str] | None = None) -> DataFrame:
    """(value): a JSON list, else the seed where there is no file."""
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "array<string>")).alias("value")).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(v,) for v in seed or []], "value string")


def reference_map(spark: SparkSession, path: str, seed: dict[str, str] | None = None) -> DataFrame:
    """(key, value): a JSON object, else the seed where there is no file."""
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame(list((seed or {}).items()), "key string, value string")


def groups_and_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed groups {resourceName, name, groupType, members: [...]} -> groups and
    (label, contact) of those that users made."""
    raw = spark.read.schema("resourceName STRING, name STRING, groupType STRING, members ARRAY<STRING>").json(path)
    groups = raw.select("resourceName", F.col("name").alias("label"), "groupType")
    return groups, raw.where("groupType = 'USER_CONTACT_GROUP'").select(F.col("name").alias("label"), F.explode("members").alias("contact")).distinct()


def contact(contacts: DataFrame, resource_name: str, fields: list[str] | None = None) -> DataFrame:
    """One contact, with the fields asked for only."""
    found = contacts.where(F.col("resourceName") == resource_name)
    return found.select("resourceName", *fields) if fields else found


def notes_snapshot(contacts: DataFrame, path: str) -> None:
    """Saves every contact's first note."""
    contacts.select("resourceName", F.try_element_at("biographies", F.lit(1)).value.alias("note")).where("note is not null").write.mode("errorifexists").parquet(path)


def notes_to_restore(spark: SparkSession, path: str, contacts: DataFrame) -> DataFrame:
    """(resource_name, field, old, new): what brings the saved notes back."""
    saved = spark.read.parquet(path)
    now = contacts.select("resourceName", F.try_element_at("biographies", F.lit(1)).value.alias("current"))
    changed = saved.join(now, "resourceName").where(~F.col("note").eqNullSafe(F.col("current")))
    return changed.select(F.col("resourceName").alias("resource_name"), F.lit("biographies[0].value").alias("field"), F.coalesce("current", F.lit("")).alias("old"), F.col("note").alias("new"))
