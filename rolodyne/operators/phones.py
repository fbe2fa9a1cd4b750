"""International phone numbers by a numbering plan that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a plan: the digits a number begins with (country code and what of the
#: national number tells its kind), the lengths of the whole number without +, its
#: region and kind, the trunk digit dropped within the region, and the size of the
#: country code.
PLAN = "prefix string, lengths array<int>, region string, kind string, trunk string, code_size int"


def international(raw: Column, code: Column | str, trunk: Column | str = "0") -> Column:
    """Digits with the country code: after + or 00 as they are, else those of the
    region that `code` names, without its trunk digit."""
    code, trunk = (x if isinstance(x, Column) else F.lit(x) for x in (code, trunk))
    digits = F.regexp_replace(raw, r"\D", "")
    home = F.when((trunk != "") & digits.startswith(trunk), F.substring(digits, F.length(trunk) + 1, F.length(digits))).otherwise(digits)
    return F.when(F.ltrim(raw).startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, F.lit(3), F.length(digits))).otherwise(F.concat(code, home))


def normalise(numbers: DataFrame, plan: DataFrame, code: str, trunk: str = "0", value: str = "phone") -> DataFrame:
    """numbers with e164, region, kind and reason: why there is no number, null
    where there is one.

    Of the plan's prefixes the longest counts that fits and has the number's
    length; each distinct number meets the plan once for every length of prefix,
    in a join by equality. Numbers that neither work as they are nor (written
    without + or 00) within the home region are told apart: empty, letters only,
    prefix unknown, too short, too long."""
    raw = F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))
    distinct = numbers.select(raw.alias("_raw")).distinct()
    tries = F.array(F.struct(F.lit(0).alias("nth"), international(F.col("_raw"), code, trunk).alias("d")), F.struct(F.lit(1).alias("nth"), F.regexp_replace("_raw", r"\D", "").alias("d")))
    asked = distinct.select("_raw", F.explode(tries).alias("x")).select("_raw", "x.*").where("d <> ''")
    sizes = sorted(r.n for r in plan.select(F.length("prefix").alias("n")).distinct().collect())  # as many as prefixes have lengths
    starts = F.filter(F.transform(F.array(*map(F.lit, sizes or [1])), lambda n: F.left(F.col("d"), n)), lambda p: F.length(p) <= F.length("d"))
    met = asked.select("_raw", "nth", "d", F.explode(F.array_distinct(starts)).alias("prefix")).join(plan, "prefix")
    fits = F.array_contains("lengths", F.length("d"))
    found = met.groupBy("_raw").agg(
        F.min(F.when(fits, F.struct("nth", (-F.length("prefix")).alias("size"), "region", "kind", "d"))).alias("hit"),
        F.max(F.when(F.col("nth") == 0, F.struct(F.length("prefix").alias("size"), F.length("d").alias("n"), F.array_max("lengths").alias("most")))).alias("near"),
    )
    reason = (
        F.when(F.col("_raw") == "", "empty")
        .when(F.regexp_replace("_raw", r"\D", "") == "", "no digits")
        .when(F.col("hit").isNotNull(), F.lit(None))
        .when(F.col("near").isNull(), "unknown prefix")
        .when(F.col("near.n") > F.col("near.most"), "too long")
        .when(F.col("near.n") < F.col("near.most"), "too short")
        .otherwise("unknown prefix")
    )
    told = distinct.join(found, "_raw", "left").select("_raw", F.concat(F.lit("+"), F.col("hit.d")).alias("e164"), F.col("hit.region").alias("region"), F.col("hit.kind").alias("kind"), reason.alias("reason"))
    return numbers.withColumn("_raw", raw).join(told, "_raw", "left").drop("_raw")


def failures(normalised: DataFrame) -> DataFrame:
    """How many values gave no number, by reason."""
    return normalised.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
