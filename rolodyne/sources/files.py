"""Snapshots, logs, lists and partitions as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_id
from ..schemas import CONTACT, INTERACTION, LOG


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Landed contact pages: JSON, one contact a line."""
    return spark.read.schema(CONTACT).json(path)


def write_snapshot(contacts: DataFrame, path: str) -> dict:
    """Writes a full snapshot and checks it: rows, empty keys, repeated keys."""
    contacts.write.mode("errorifexists").json(path)
    back = read_contacts(contacts.sparkSession, path)
    s = back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("resourceName", F.lit("")) == "").alias("keyless"), F.countDistinct("resourceName").alias("keys")).first()
    expected = contacts.count()
    return {"rows": s.rows, "expected": expected, "keyless": s.keyless, "keys": s["keys"], "ok": s.rows == expected and not s.keyless}


def latest_path(spark: SparkSession, folder: str, prefix: str, without: tuple[str, ...] = ()) -> str | None:
    """The last file or folder by name that begins with prefix."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = sorted(n for n in names if n.startswith(prefix) and not any(w in n for w in without))
    return f"{folder}/{found[-1]}" if found else None


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """An external list as CSV: header names trimmed and lower case, values
    trimmed, rows without any name left out."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    rows = raw.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.replace(" ", "_")) for c in raw.columns))
    return rows.where((F.col("first_name") != "") | (F.col("last_name") != ""))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """A list of domains: lower case, without comments and malformed lines."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("value"))
    return lines.where(~F.col("value").startswith("#") & F.col("value").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")).distinct()


def read_messages(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Message partitions (ym=yyyy-MM); malformed lines drop out."""
    rows = spark.read.schema(f"{INTERACTION}, ym STRING").option("mode", "DROPMALFORMED").json(path).where("interactionId is not null")
    return rows.where(F.col("ym").isin(months)) if months else rows


def append_messages(messages: DataFrame, path: str) -> None:
    """Adds messages to their months' partitions (UTC)."""
    messages.withColumn("ym", F.date_format("timestamp", "yyyy-MM")).write.mode("append").partitionBy("ym").json(path)


def new_messages(messages: DataFrame, path: str) -> DataFrame:
    """Messages whose id isn't yet in the partition of their month; of repeated
    ids one. Only the months at hand are read."""
    spark = messages.sparkSession
    once = messages.dropDuplicates(["interactionId"]).withColumn("ym", F.date_format("timestamp", "yyyy-MM"))
    months = [r.ym for r in once.select("ym").distinct().collect()]  # one a month
    try:
        there = read_messages(spark, path, months).select("interactionId", "ym")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return once.drop("ym")
    return once.join(there, ["interactionId", "ym"], "left_anti").drop("ym")


def read_log(spark: SparkSession, pattern: str, since: str | None = None) -> DataFrame:
    """Change logs; with since (yyyy-MM-dd) only files whose name has that date or a later one."""
    log = spark.read.schema(LOG).json(pattern).select("*", F.col("_metadata.file_name").alias("file"))
    return log.where(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1) >= since) if since else log


def write_log(changes: DataFrame, path: str, session: str, batch: int, failed: int = 0) -> None:
    """Appends changes with a start and an end marker of their batch; of its
    contacts `failed` did not go through. Files follow the number of changes."""
    spark = changes.sparkSession
    rows = changes.select(F.lit(None).cast("string").alias("type"), F.current_timestamp().alias("timestamp"), F.col("resource_name").alias("resourceName"), "field", "old", "new", "reason", "confidence", F.lit(batch).alias("batch"), F.lit(None).cast("int").alias("contact_count"), F.lit(None).cast("int").alias("success"), F.lit(None).cast("int").alias("failed"), F.lit(session).alias("session_id"))
    counts = changes.agg(F.countDistinct("resource_name").alias("contacts"), F.count(F.lit(1)).alias("rows")).first()
    lost = min(failed, counts.contacts)
    marks = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    start = marks.withColumns({"type": F.lit("batch_start"), "timestamp": F.current_timestamp(), "batch": F.lit(batch), "contact_count": F.lit(counts.contacts).cast("int"), "session_id": F.lit(session)})
    end = marks.withColumns({"type": F.lit("batch_end"), "timestamp": F.current_timestamp(), "batch": F.lit(batch), "success": F.lit(counts.contacts - lost).cast("int"), "failed": F.lit(lost).cast("int"), "session_id": F.lit(session)})
    files = -(-counts.rows // LOG_ROWS)
    whole = start.unionByName(rows.coalesce(max(1, files))).unionByName(end)
    whole.write.mode("append").json(path)


#: So many changes fill a log file.
LOG_ROWS = 200_000


# --- searching logs ------------------------------------------------------------

SEARCHED = ["resourceName", "field", "old", "new", "reason"]


def _trigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(0)), F.lit(1)), lambda k: F.substring(c, k, F.lit(3))))


def searched_text() -> Column:
    return F.lower(F.concat_ws(" ", *SEARCHED))


def index_log(spark: SparkSession, pattern: str, index: str) -> int:
    """Adds the log files not yet indexed: for each file the three-character pieces
    that its lines hold, sorted by piece. Returns how many files were added."""
    log = read_log(spark, pattern).select(F.col("_metadata.file_path").alias("path"), *SEARCHED)
    known = _indexed(spark, index)
    files = log.select("path").distinct()
    fresh = [r.path for r in (files if known is None else files.join(known.select("path").distinct(), "path", "left_anti")).collect()]  # one a file
    if not fresh:
        return 0
    new = spark.read.schema(LOG).json(fresh).select(F.col("_metadata.file_path").alias("path"), searched_text().alias("s"))
    pieces = new.where("length(s) > 2").select("path", F.explode(_trigrams(F.col("s"))).alias("piece")).distinct()
    # files without a line that is long enough are known, too
    all_files = pieces.unionByName(new.select("path", F.lit("").alias("piece")).distinct())
    all_files.repartitionByRange("piece").sortWithinPartitions("piece").write.mode("append").parquet(index)
    return len(fresh)


def _indexed(spark: SparkSession, index: str) -> DataFrame | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(index)
    return spark.read.schema("path string, piece string").parquet(index) if root.getFileSystem(conf).exists(root) else None


def search_log(spark: SparkSession, pattern: str, index: str, needle: str) -> DataFrame:
    """Lines of indexed and new log files that hold the needle in any of the fields
    searched, whatever its case. Only files that hold all its pieces of three
    characters are read; shorter needles read all."""
    low = needle.lower()
    known = _indexed(spark, index)
    if known is None or len(low) < 3:
        return read_log(spark, pattern).where(searched_text().contains(low))
    wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    hits = known.where(F.col("piece").isin(wanted)).groupBy("path").agg(F.countDistinct("piece").alias("n")).where(F.col("n") == len(wanted))
    there = read_log(spark, pattern).select(F.col("_metadata.file_path").alias("path")).distinct()
    new = there.join(known.select("path").distinct(), "path", "left_anti")
    paths = [r.path for r in hits.select("path").join(there, "path", "left_semi").unionByName(new).collect()]  # one a file
    if not paths:
        return read_log(spark, pattern).limit(0)
    log = spark.read.schema(LOG).json(paths).select("*", F.col("_metadata.file_name").alias("file"))
    return log.where(searched_text().contains(low))


# --- generations of a snapshot ---------------------------------------------------

GENERATION = "generation LONG, path STRING, at TIMESTAMP, rows LONG, digest DECIMAL(38,0), note STRING, deleted BOOLEAN, data LONG"


def generations(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a versioned snapshot: one row a generation, newest first;
    data is the generation whose files it has (another one's after a restore)."""
    folder = f"{root}/_manifest"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], GENERATION)
    return spark.read.schema(GENERATION).json(folder).orderBy(F.desc("generation"))


def _publish(spark: SparkSession, root: str, entry: dict) -> None:
    """A manifest file of its own for each generation: two writers that choose the
    same number can't both create it."""
    import json

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{entry['generation']:012d}.json")
    out = path.getFileSystem(conf).create(path, False)
    try:
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
    finally:
        out.close()


def _next(spark: SparkSession, root: str) -> int:
    return (generations(spark, root).agg(F.max("generation")).first()[0] or 0) + 1


def _digest(rows: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of their hashes: the same for the same rows in any order."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).alias("d")).first()
    return s.n, int(s.d)


def write_generation(rows: DataFrame, root: str, note: str = "", at: str | None = None) -> int:
    """Writes rows as a further generation of a snapshot and publishes it, after
    it was read back: readers see all of it or nothing. Returns its number."""
    import uuid
    from datetime import UTC, datetime

    spark = rows.sparkSession
    path = f"{root}/data-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    n, digest = _digest(spark.read.schema(rows.schema).parquet(path))
    number = _next(spark, root)
    _publish(spark, root, {"generation": number, "path": path, "at": at or datetime.now(UTC).isoformat(), "rows": n, "digest": digest, "note": note, "deleted": False, "data": number})
    return number


def read_generation(spark: SparkSession, root: str, number: int | None = None, as_of: str | None = None) -> DataFrame:
    """A generation by number, the last one at an instant, or the last; a deleted
    last one leaves none."""
    known = generations(spark, root)
    if number is not None:
        known = known.where(F.col("generation") == number)
    if as_of is not None:
        known = known.where(F.col("at") <= F.lit(as_of).cast("timestamp"))
    last = known.orderBy(F.desc("generation")).first()
    if last is None or last.deleted:
        raise ValueError("there is no such generation")
    return spark.read.parquet(last.path)


def restore_generation(spark: SparkSession, root: str, number: int, at: str | None = None) -> int:
    """Makes an earlier generation the last one again, by its files, once they have
    been found as they were written; also after the snapshot was deleted."""
    from datetime import UTC, datetime

    old = generations(spark, root).where((F.col("generation") == number) & ~F.col("deleted")).first()
    if old is None:
        raise ValueError("there is no such generation")
    if _digest(spark.read.parquet(old.path)) != (old.rows, int(old.digest)):
        raise ValueError("the files of the generation have changed")
    new = _next(spark, root)
    _publish(spark, root, {"generation": new, "path": old.path, "at": at or datetime.now(UTC).isoformat(), "rows": old.rows, "digest": int(old.digest), "note": f"restored {number}", "deleted": False, "data": old.data})
    return new


def delete_snapshot(spark: SparkSession, root: str, at: str | None = None) -> int:
    """A generation that says there is none; earlier ones can be restored."""
    from datetime import UTC, datetime

    new = _next(spark, root)
    _publish(spark, root, {"generation": new, "path": None, "at": at or datetime.now(UTC).isoformat(), "rows": 0, "digest": 0, "note": "deleted", "deleted": True, "data": None})
    return new


def read_session(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """A session's payload {healthy, chats: [{id, network, messages: [...]}]} as
    messages; one that isn't healthy, or has no chats, is refused."""
    schema = "healthy BOOLEAN, chats ARRAY<STRUCT<id: STRING, network: STRING, messages: ARRAY<STRUCT<id: STRING, timestamp: STRING, text: STRING, isSender: BOOLEAN, sender: STRING>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = raw.where(~F.coalesce("healthy", F.lit(False)) | (F.lit(not allow_empty) & (F.coalesce(F.size("chats"), F.lit(0)) <= 0)))
    if not bad.isEmpty():
        raise ValueError("the session is not healthy or has no chats")
    m = raw.select(F.explode("chats").alias("c")).select(F.col("c.id").alias("chat"), "c.network", F.explode("c.messages").alias("m"))
    return m.select(short_id(F.col("network"), F.col("chat"), F.col("m.id")).alias("interactionId"), F.col("network").alias("channel"), F.col("chat").alias("threadId"), F.when(F.col("m.isSender"), "outbound").otherwise("inbound").alias("direction"), F.try_to_timestamp("m.timestamp").alias("timestamp"), F.col("m.text").alias("summary"), F.col("m.sender").alias("sender"))


def items(column: Column, key: str, element: str) -> Column:
    """A response that is a list, or an object holding it under key, items or data."""
    plain = F.from_json(column, f"array<{element}>")
    held = F.from_json(column, f"struct<{key}: array<{element}>, items: array<{element}>, data: array<{element}>>")
    is_list = F.ltrim(column).startswith("[")
    return F.when(is_list, plain).otherwise(F.coalesce(held[key], held["items"], held["data"]))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON document as one row, or None where there is no such file; any other
    failure is raised, and so is a document that isn't JSON."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_document(spark: SparkSession, path: str, document: dict, tries: int = 2) -> None:
    """Writes a small JSON document in place of the one there, whole or not at all:
    beside it first, then renamed; tried once more where writing fails."""
    import json
    import uuid

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    fs = target.getFileSystem(conf)
    for attempt in range(tries):
        try:
            out = fs.create(beside, True)
            try:
                out.write(bytearray(json.dumps(document, ensure_ascii=False).encode()))
            finally:
                out.close()
            if fs.exists(target):
                fs.delete(target, False)
            if not fs.rename(beside, target):
                raise OSError(f"{path} can't be renamed")
            return
        except Exception:  # the second failure is raised
            if attempt == tries - 1:
                raise


def keep_runs(runs: DataFrame, new: DataFrame, key: str, by: str, most: int = 90) -> DataFrame:
    """A bounded run log: new rows replace those of their key, the last `most` stay."""
    old = runs.join(new.select(key), key, "left_anti")
    return old.unionByName(new).orderBy(F.desc(by)).limit(most)
