"""Applying proposals to contacts, and planning how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..schemas import DELETE, DUPLICATE, INVALID
from .audit import band, batches

PATH = r"^([A-Za-z]+)\[(\+|\d+)\](?:\.([A-Za-z]+))?$"
#: Other names of the repeated fields.
ALIASES = {"name": "names", "phone": "phoneNumbers", "phones": "phoneNumbers", "email": "emailAddresses", "emails": "emailAddresses", "address": "addresses", "organization": "organizations", "url": "urls", "birthday": "birthdays", "event": "events", "note": "biographies", "notes": "biographies"}
#: Which part of an entry a plain value stands for.
MAIN = {"addresses": "formattedValue", "names": "givenName", "organizations": "name"}
FIELDS = ["names", "phoneNumbers", "emailAddresses", "addresses", "organizations", "urls", "birthdays", "events", "userDefined", "biographies", "nicknames"]


def parsed_path(path: Column) -> Column:
    """struct(array, index, sub) of a field path; index is null for [+]."""
    part = lambda k: F.regexp_extract(path, PATH, k)
    array = part(1)
    for alias, name in ALIASES.items():
        array = F.when(part(1) == alias, F.lit(name)).otherwise(array)
    return F.struct(array.alias("array"), part(2).try_cast("int").alias("index"), part(3).alias("sub"), (part(2) == "+").alias("appends"))


def split_auto(changes: DataFrame, threshold: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """What is applied at once, and what goes to review."""
    sure = F.col("confidence") >= threshold
    return changes.where(sure & ~F.col("new").isin(DUPLICATE, INVALID, DELETE)), changes.where(~sure)


def medium(changes: DataFrame) -> DataFrame:
    return changes.where(band(F.col("confidence")) == "medium")


def needs_review(changes: Column, sure: float = 0.90) -> Column:
    """Whether any of a contact's changes (array of struct) is less than sure."""
    return F.exists(changes, lambda c: c.confidence < sure)


def review_file(changes: DataFrame) -> DataFrame:
    """Per contact its real changes, in order; contacts without any drop out."""
    real = changes.where(~F.col("old").eqNullSafe(F.col("new")))
    return real.groupBy("resource_name").agg(F.array_sort(F.collect_list(F.struct("seq", "field", "old", "new", "confidence", "reason"))).alias("changes"))


def workplan(stats: DataFrame, changes: DataFrame, size: int = 50) -> DataFrame:
    """Changes with the batch of their contact, the most certain contacts first."""
    return batches(stats, size).select("resource_name", "batch", "rank").join(changes, "resource_name")


def _date(c: Column) -> Column:
    """struct(year, month, day) of YYYY-MM-DD or of a JSON object; null for others."""
    part = lambda k: F.regexp_extract(c, r"^(\d+)-(\d+)-(\d+)$", k).cast("int")
    whole = F.when(c.rlike(r"^\d{1,9}-\d{1,9}-\d{1,9}$"), F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day")))
    given = F.from_json(c, "year int, month int, day int")
    return F.coalesce(whole, F.when(given.month.isNotNull(), given))


def _new_entry(array: str, kind: StructType, c: Column) -> Column:
    """What a change [+] appends: the main or named part, and a type where entries
    have one; null where it names no date."""
    extra = lambda key, other: F.coalesce(F.element_at(c.extra, key), F.lit(other))
    typed = {"type": extra("type", "other")} if array in ("phoneNumbers", "emailAddresses", "urls", "addresses", "events") else {}
    if array in ("birthdays", "events"):
        day = F.coalesce(_date(F.element_at(c.extra, "date")), _date(c.new))
        return F.when(day.isNotNull(), _struct(kind, {"date": day} | typed))
    if array == "userDefined":
        return _struct(kind, {"key": extra("key", ""), "value": F.coalesce(F.element_at(c.extra, "value"), c.new)})
    return _with_part(kind, _struct(kind, typed), c)


def _struct(kind: StructType, parts: dict[str, Column]) -> Column:
    return F.struct(*(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))


def _with_part(kind: StructType, entry: Column, c: Column) -> Column:
    """An entry with the part that a change names; parts that hold no text stay."""
    return F.struct(*((F.when(c.part == f.name, c.new).otherwise(entry[f.name]) if isinstance(f.dataType, StringType) else entry[f.name]).alias(f.name) for f in kind))


def _changed(array: str, entries: Column, kind: StructType, changes: Column) -> Column:
    """An array of entries after its changes, one after the other; entries to be
    removed are marked, so that numbers mean the same until the end."""
    state = F.struct(F.coalesce(entries, F.array().cast(ArrayType(kind))).alias("list"), F.array().cast("array<int>").alias("gone"))

    def step(done: Column, c: Column) -> Column:
        def put(at: Column) -> Column:
            return F.transform(done["list"], lambda e, i: F.when(i == at, _with_part(kind, e, c)).otherwise(e))

        new = _new_entry(array, kind, c)
        appended = F.concat(done["list"], F.array_compact(F.array(new)))
        if array == "names":  # a person has one name: its parts go to the first entry
            appended = F.when(F.size(done["list"]) > 0, put(F.lit(0))).otherwise(appended)
        there = c.index < F.size(done["list"])
        removes = there & (c.new == "") & (c["sub"] == "")
        entries = F.when(c.appends, appended).when(there & ~removes, put(c.index)).otherwise(done["list"])
        gone = F.when(~c.appends & removes, F.concat(done["gone"], F.array(c.index))).otherwise(done["gone"])
        return F.struct(entries.alias("list"), gone.alias("gone"))

    return F.aggregate(changes, state, step, lambda done: F.filter(done["list"], lambda e, i: ~F.array_contains(done["gone"], i)))


def apply_changes(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Contacts after their changes (resource_name, seq, field, new, extra map), in
    the order of seq; contacts without any pass.

    [+] appends an entry (names: fills the first one), an index sets the part named
    or the main one, an empty new value without a part removes the entry. A birthday
    or event takes its date from extra, else from the new value. Unknown paths,
    indexes beyond the end and dates that are none change nothing; a null new value
    sets null. One contact's changes meet in one row, never more; all work is column
    expressions over its arrays. Other columns stay as they are."""
    arrays = {f.name: f.dataType.elementType for f in contacts.schema if f.name in FIELDS and isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)}
    path = parsed_path(F.col("field"))
    main = F.lit("value")
    for array, name in MAIN.items():
        main = F.when(F.col("p.array") == array, F.lit(name)).otherwise(main)
    part = F.when(F.col("p.sub").isin("", "value"), main).otherwise(F.col("p.sub"))
    extra = F.col("extra") if isinstance(changes.schema["extra"].dataType, MapType) else F.lit(None).cast("map<string,string>")
    known = changes.withColumn("p", path).where(F.col("p.array").isin(list(arrays)) & (F.col("p.appends") | F.col("p.index").isNotNull()))
    todo = known.groupBy("resource_name").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("p.array").alias("array"), F.coalesce("p.index", F.lit(-1)).alias("index"), F.col("p.sub").alias("sub"), F.col("p.appends").alias("appends"), part.alias("part"), "new", F.map_entries(extra).alias("extra")))).alias("_todo"))
    whole = contacts.join(todo, F.col("resourceName") == F.col("resource_name"), "left")
    # maps don't sort; they are rebuilt once sorted
    whole = whole.withColumn("_todo", F.transform("_todo", lambda c: c.withField("extra", F.map_from_entries(c.extra))))

    def after(name: str) -> Column:
        own = F.filter("_todo", lambda c: c.array == name)
        return F.when(F.exists("_todo", lambda c: c.array == name), _changed(name, contacts[name], arrays[name], own)).otherwise(contacts[name]).alias(name)

    return whole.select(*(after(name) if name in arrays else contacts[name] for name in contacts.columns))
