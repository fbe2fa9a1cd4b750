"""Kept days, hot threads, matches learned in a stream, numbering plans, log search and generations."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from rolodyne.operators import activity as A
from rolodyne.operators import daily, phones
from rolodyne.sources import files
from rolodyne.streaming import ingest

EVENT = "contact_id string, event_id long, ts timestamp, direction string, channel string, thread_id string, body string"


def made_events(spark, n, seed=1, contacts=12, threads=3, days=120, hot=None):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        contact = hot or f"c{r.randrange(contacts)}"
        at = start + timedelta(minutes=r.randrange(days * 24 * 4) * 15)
        rows.append((contact, k, at, r.choice(["inbound", "outbound", "outbound", "draft", None]), r.choice(["email", "sms", "chat", "", None]), f"{contact}-{0 if hot else r.randrange(threads)}", r.choice(["an offer", "hi", None])))
    return spark.createDataFrame(rows, EVENT)


def same(a, b):
    key = lambda rows: sorted(rows, key=str)
    assert key([tuple(r) for r in a.select(*b.columns).collect()]) == key([tuple(r) for r in b.collect()])


@pytest.mark.parametrize("as_of", ["2024-04-15 00:00:00", "2024-04-15 13:20:00", "2023-12-31 00:00:00"])
def test_kept_days_equal_a_full_run(spark, tmp_path, as_of):
    events, path = made_events(spark, 3000), str(tmp_path / "days")
    cut = F.lit("2024-03-10 07:00:00").cast("timestamp")
    daily.add_batch(events.where(F.col("ts") < cut), path, "1", A.KEYWORDS)
    daily.add_batch(events.where(F.col("ts") >= cut), path, "2", A.KEYWORDS)
    daily.add_batch(events.where(F.col("ts") >= cut), path, "2", A.KEYWORDS)  # run again
    days = daily.read_days(spark, path)
    same(daily.window_figures(days, events, as_of, keywords=A.KEYWORDS), A.window_kpis(events, as_of, keywords=A.KEYWORDS))
    full = A.first_last(events).join(A.awaiting_side(events), "contact_id")
    same(daily.history_figures(days), full)
    same(daily.main_channel(days, "2024-04-15 00:00:00"), A.primary_channel(events, "2024-04-15 00:00:00"))
    daily.compact(spark, path, str(tmp_path / "one"))
    one = daily.read_days(spark, str(tmp_path / "one"))
    assert one.groupBy("contact_id", "channel", "day").count().where("count > 1").isEmpty()
    same(daily.window_figures(one, events, as_of, keywords=A.KEYWORDS), A.window_kpis(events, as_of, keywords=A.KEYWORDS))


def test_an_update_reads_only_its_days(spark, tmp_path):
    events, path = made_events(spark, 500), str(tmp_path / "days")
    daily.add_batch(events, path, "1")
    plan = daily.window_figures(daily.read_days(spark, path, "2024-03"), None, "2024-04-01 00:00:00", (30,))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "DataFilters: [isnotnull(day" in plan
    assert daily.window_figures(daily.read_days(spark, path).limit(0), events.limit(0), "2024-04-01 00:00:00").count() == 0


def plain_pairs(events, trigger, response, thread):
    back = Window.partitionBy(*thread).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("direction") == response, F.col("ts")), ignorenulls=True).over(back)
    return events.withColumn("response_ts", following).where((F.col("direction") == trigger) & (F.col("response_ts") > F.col("ts")))


def plain_stale(events, as_of):
    recent = A.usable(events).where(F.col("ts") >= A.before(as_of, 30))
    back = Window.partitionBy("contact_id", "thread_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    answered = F.max(F.when(F.col("direction") == "inbound", F.col("ts"))).over(back)
    stale = (F.col("direction") == "outbound") & (F.col("ts") <= A.before(as_of, 7)) & F.col("answer").isNull()
    return recent.withColumn("answer", answered).groupBy("contact_id").agg(F.count_if(stale).alias("stale_sent"))


@pytest.mark.parametrize("hot", [None, "c0"])
def test_stretches_of_threads_equal_one_window(spark, hot):
    events = made_events(spark, 2500, 4, hot=hot, days=60)
    events = events.withColumn("thread_id", F.when(F.col("event_id") % 50 != 0, F.col("thread_id")))  # null threads, too
    for a, b in (("inbound", "outbound"), ("outbound", "inbound")):
        for every in (86_400, 3_600, 10**9):
            same(A.response_pairs(events, a, b, ["contact_id", "thread_id"], every), plain_pairs(events, a, b, ["contact_id", "thread_id"]))
    for as_of in ("2024-02-20 10:00:00", "2024-03-20 00:00:00"):
        same(A.stale_sent(events, as_of), plain_stale(events, as_of))


def test_one_thread_of_all_messages_spreads(spark):
    """No task of the windows has a large part of a single thread's rows."""
    events = spark.range(40_000).select(F.lit("c").alias("contact_id"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 300).alias("ts"), F.when(F.col("id") % 3 == 0, "inbound").otherwise("outbound").alias("direction"), F.lit("email").alias("channel"), F.lit("t").alias("thread_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = A.response_pairs(events, "inbound", "outbound", ["contact_id", "thread_id"])
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 13_333 and len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_matches_learned_in_a_stream(spark, tmp_path):
    """Rows in any order, in several batches and with repeats give what a batch gives."""
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(f"h{k % 17}" if k % 40 else None, k, f"p{k % 17}" if k % 17 < 12 and r.random() < 0.15 else None, start + timedelta(minutes=k)) for k in range(600)]
    known = {h for h, _, c, _ in rows if c and h}
    want = {(h, k, f"p{h[1:]}") for h, k, _, _ in rows if h in known}
    src = tmp_path / "in"
    shuffled = rows + rows[::3]
    r.shuffle(shuffled)
    schema = "handle string, event_id long, contact_id string, ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in range(3):
        spark.createDataFrame(shuffled[part::3], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        query = ingest.matched_stream(stream).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(out).select("handle", "event_id", "contact_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # much later: what still waits is given out without a contact, learned contacts are forgotten
    later = start + timedelta(days=90)
    spark.createDataFrame([("new", 10_000, "p", later)], schema).write.mode("append").parquet(str(src))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(src))
        query = ingest.matched_stream(stream).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.createDataFrame([(f"h{next(iter(known))[1:]}", 20_000 + k, None, later + timedelta(days=1))], schema).write.mode("append").parquet(str(src))
    got = {tuple(x) for x in spark.read.parquet(out).select("handle", "event_id", "contact_id").collect()}
    unknown = {(h, k, None) for h, k, _, _ in rows if h and h not in known}
    assert unknown <= got and {x for x in got if x[1] < 10_000} == want | unknown
    assert not any(x[1] >= 20_000 and x[2] for x in got)


PLAN = [("1", [11], "US", "unknown", "1", 1), ("44", [12], "GB", "fixed_line", "0", 2), ("447", [12], "GB", "mobile", "0", 2), ("49", [11, 12], "DE", "fixed_line", "0", 2), ("4915", [13], "DE", "mobile", "0", 2), ("4917", [12, 13], "DE", "mobile", "0", 2), ("33", [11], "FR", "fixed_line", "0", 2), ("336", [11], "FR", "mobile", "0", 2), ("39", [10, 11, 12], "IT", "fixed_line", "", 2), ("421", [12], "SK", "fixed_line", "0", 3), ("4219", [12], "SK", "mobile", "0", 3), ("420", [12], "CZ", "fixed_line", "", 3), ("352", [9, 10, 11], "LU", "fixed_line", "", 3), ("352621", [12], "LU", "mobile", "", 3)]


def test_numbers_of_ten_countries(spark):
    cases = [
        ("+44 7700 900123", "+447700900123", "GB", "mobile", None),
        ("0044 20 7946 0958", "+442079460958", "GB", "fixed_line", None),
        ("+49 1512 3456789", "+4915123456789", "DE", "mobile", None),
        ("+49 30 1234567", "+49301234567", "DE", "fixed_line", None),
        ("+33 6 12 34 56 78", "+33612345678", "FR", "mobile", None),
        ("+39 06 698 1234", "+39066981234", "IT", "fixed_line", None),
        ("+1 (212) 555-0123", "+12125550123", "US", "unknown", None),
        ("0903 123 456", "+421903123456", "SK", "mobile", None),
        ("903123456", "+421903123456", "SK", "mobile", None),
        ("420 601 123 456", "+420601123456", "CZ", "fixed_line", None),  # no number at home, but with its own code
        ("+352 621 123 456", "+352621123456", "LU", "mobile", None),
        ("+352 123456", "+352123456", "LU", "fixed_line", None),  # the longest prefix with that length
        ("", None, None, None, "empty"),
        (None, None, None, None, "empty"),
        ("call me", None, None, None, "no digits"),
        ("+999 123456789", None, None, None, "unknown prefix"),
        ("+44 77", None, None, None, "too short"),
        ("+44 7700 900123 99", None, None, None, "too long"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases * 2)], "id long, phone string")
    plan = spark.createDataFrame(PLAN, phones.PLAN)
    out = phones.normalise(df, plan, "421")
    got = {r.id: (r.e164, r.region, r.kind, r.reason) for r in out.collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases * 2)}
    assert {r.reason: r.n for r in phones.failures(out).collect()} == {"empty": 4, "no digits": 2, "unknown prefix": 2, "too short": 2, "too long": 2}
    assert phones.normalise(df, plan.limit(0), "421").where("reason is null").isEmpty() and phones.normalise(df.limit(0), plan, "421").count() == 0


def test_indexed_log_search(spark, tmp_path):
    r = random.Random(3)
    index, folder = str(tmp_path / "index"), tmp_path / "log"
    folder.mkdir()
    words = ["alpha", "beta", "Gamma", "delta", "ábc", "x[0]", "people/c12", "", "sro"]

    def add(day):
        rows = [{"resourceName": f"people/c{r.randrange(30)}", "field": r.choice(words), "old": r.choice(words), "new": f"{r.choice(words)} {r.choice(words)}", "reason": f"needle{day}" if k == 5 else r.choice(words)} for k in range(40)]
        (folder / f"changes-2024-01-{day:02d}.json").write_text("\n".join(map(json.dumps, rows)))

    for day in range(1, 9):
        add(day)
    pattern = f"{folder}/*.json"
    assert files.index_log(spark, pattern, index) == 8 and files.index_log(spark, pattern, index) == 0
    add(9)  # not indexed yet: found all the same
    log = files.read_log(spark, pattern)
    rows = lambda df: sorted((tuple(x) for x in df.select("file", *files.SEARCHED).collect()), key=str)
    for needle in ("needle3", "NEEDLE9", "gamma ÁBC", "x[0]", "c12 ", "al", "", "nothing at all", "people/c1"):
        got = files.search_log(spark, pattern, index, needle)
        assert rows(got) == rows(log.where(files.searched_text().contains(needle.lower()))), needle
    assert files.index_log(spark, pattern, index) == 1
    assert len(files.search_log(spark, pattern, index, "needle3").inputFiles()) == 1
    assert files.search_log(spark, pattern, index, "zzzz").isEmpty()


def test_generations_of_a_snapshot(spark, tmp_path):
    root = str(tmp_path / "contacts")
    rows = lambda n: spark.range(n).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    assert files.generations(spark, root).count() == 0
    for k, n in enumerate((5, 8, 3)):
        assert files.write_generation(rows(n), root, f"run {k}", f"2024-01-0{k + 1}T00:00:00Z") == k + 1
    assert [r.rows for r in files.generations(spark, root).collect()] == [3, 8, 5]
    assert files.read_generation(spark, root).count() == 3 and files.read_generation(spark, root, 2).count() == 8
    assert files.read_generation(spark, root, as_of="2024-01-02T12:00:00Z").count() == 8
    assert files.restore_generation(spark, root, 1, "2024-01-04T00:00:00Z") == 4 and files.read_generation(spark, root).count() == 5
    files.delete_snapshot(spark, root, "2024-01-05T00:00:00Z")
    with pytest.raises(ValueError):
        files.read_generation(spark, root)
    assert files.read_generation(spark, root, as_of="2024-01-04T12:00:00Z").count() == 5
    files.restore_generation(spark, root, 2)
    assert files.read_generation(spark, root).count() == 8
    assert files.generations(spark, root).first().data == 2
    with pytest.raises(ValueError):
        files.restore_generation(spark, root, 99)
    with pytest.raises(Exception):  # a number is given once
        files._publish(spark, root, {"generation": 3, "path": "x"})
