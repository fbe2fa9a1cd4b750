from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rolodyne.functions import parsing as X
from rolodyne.operators import outreach as O
from rolodyne.operators import status as H
from rolodyne.sources import state as T


def test_profiles(spark):
    page = "Ann Lee\nCTO at Acme\nNitra\nAnn joined Acme last month\nRecent activity\nshort\nA post that is long enough to count\nAnother post that is long enough\n" + "x" * 300
    df = spark.createDataFrame([(page,), (None,), ("",)], "p string")
    a, b, c = [r[0] for r in df.select(O.profile_signals(F.col("p"))).collect()]
    assert (a.headline, a.job_change) == ("CTO at Acme", "Ann joined Acme last month") and len(a.recent_posts) == 2
    assert (b.headline, b.recent_posts) == ("", []) and c.job_change == ""
    rows = [("Acme a.s.", "Beta", "", "h"), ("Acme", "Acme Group", "posts", "h"), ("", "x", "No_recent_posts", "h"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "o string, c string, a string, h string")
    got = [tuple(r[0]) for r in df.select(O.classify_profile(F.col("o"), F.col("c"), F.col("a"), F.col("h"))).collect()]
    assert got == [("job_change", "Acme a.s. → Beta"), ("active", "posts"), ("profile", "h"), ("no_activity", "No recent public activity")]


def test_targets(spark):
    t = spark.createDataFrame([("a", "https://x/in/a"), ("b", "https://x/in/%C4%8D"), ("c", ""), ("d", "https://x/in/d")], "resource_name string, url string")
    assert [r.resource_name for r in O.pending(t, t.where("resource_name = 'd'")).collect()] == ["a"]
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-09",), (None,)], "d string")
    assert [r[0] for r in df.select(O.rescan_due(F.to_date("d"), "2024-01-10")).collect()] == [True, False, True]


def test_sync_and_checks(spark):
    cols = "resource_name string, notes string, stage string, synced_notes string, synced_stage string"
    rows = [("people/c1", "n", None, None, None), ("people/c2", "n", "inbox", "n", None), ("people/c3", "", "won", None, "lost"), ("people/x", "n", None, None, None), ("people/c4", "n", None, None, None)]
    got = O.sync_candidates(spark.createDataFrame(rows, cols), F.col("resource_name") == "people/c4")
    assert [r.resource_name for r in got.collect()] == ["people/c1", "people/c3"]
    bad = O.checked_update(spark.createDataFrame([("people/c1", "won", "x", 0.6, 0.9), ("c1", "gone", "x" * 6000, 0.9, 0.6)], "id string, stage string, notes string, medium double, high double"), ["won"])
    assert [r.errors for r in bad.collect()] == [[], ["id", "stage", "notes", "thresholds"]]


def test_meetings_and_context(spark):
    cache = spark.createDataFrame([("a", ("d", "Lunch")), ("b", ("d", "")), ("c", None)], "email string, last_meeting struct<date: string, title: string>")
    got = {r.email: r.last_meeting for r in O.drop_mass_meetings(cache, F.lit(False)).collect()}
    assert got["a"].title == "Lunch" and got["b"] is None and got["c"] is None
    df = spark.createDataFrame([("x", " "), (None, None)], "a string, b string")
    assert O.with_context(df, "a", "b").count() == 1


def test_outreach_log(spark):
    log = spark.createDataFrame([], "contact string, at string, text string, follow_up date")
    new = spark.createDataFrame([("a", "2024-01-01 10:00:00", "hi")], "contact string, at string, text string")
    assert str(O.log_message(log, new).first().follow_up) == "2024-01-08"
    names = O.display_names(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", "Ann")], "id string, name string"), spark.createDataFrame([("a", "No"), ("b", "Bob")], "id string, name string"))
    assert {r.id: r.name for r in names.collect()} == {"a": "Ann", "b": "Bob", "c": "c"}
    rows = spark.createDataFrame([("1", "b", "x"), ("2", "a", "active"), ("3", "c", "job_change")], "id string, name string, signal_type string")
    assert [r.id for r in O.sort_rows(rows, "type", ["job_change", "active"]).collect()] == ["3", "2", "1"]


def test_runs(spark):
    runs = spark.createDataFrame([("d1", {"a": 0.1, "b": None}), ("d2", {})], "date string, phases map<string, double>")
    assert [r.cost for r in H.run_cost(runs).collect()] == [0.1, None]
    calls = spark.createDataFrame([(1_000_000, 100_000)], "tokens_in long, tokens_out long")
    r = H.token_cost(calls, 0.5, 5.0).first()
    assert r.cost == 1.0 and r.exceeded
    log = spark.createDataFrame([("batch_end", "s1", 3, 1), ("batch_end", "s2", 5, 0), (None, "s1", None, None)], "type string, session_id string, success int, failed int")
    assert tuple(H.run_status(log, "s1", "2024-01-01 00:00:00", "2024-01-01 00:01:00").first()) == (3, 1, 60)
    assert tuple(H.run_status(log, None).first()) == (8, 1, None)
    scored = spark.createDataFrame([(1, "a", 9.0, "active", 2, 0.0), (2, "b", 8.0, None, 3, 5.0)], "rank int, name string, score_total double, signal string, completeness int, bonus double")
    assert H.score_file(scored, "now").count() == 3 and len(H.digest(scored).first().top) == 2
    health = H.health(spark.createDataFrame([("d1", 5, 1, 0)], "date string, duration_seconds int, changes_applied int, changes_failed int"), spark.createDataFrame([], "date string, total int"), scored, scored).first()
    assert (health.total_runs, health.pending_changes, health.signals) == (1, 0, 2)


def test_harvest_summary(spark):
    df = spark.createDataFrame([("email", "2024-01-01", "c"), ("email", "2024-01-02", None), ("sms", "2024-02-01", "c")], "channel string, t string, contactId string").withColumn("timestamp", F.col("t").cast("timestamp"))
    got = {(r.channel, r.month): (r.seen, r.new, r.unmatched) for r in H.harvest_summary(df, df.where("channel = 'email'")).collect()}
    assert got == {("email", "2024-01"): (2, 2, 1), ("sms", "2024-02"): (1, 0, 0)}


def test_parsing(spark):
    assert X.duration("24h") == timedelta(hours=24) and X.duration(" 7d ") == timedelta(days=7) and X.duration("30m") == timedelta(minutes=30)
    with pytest.raises(ValueError):
        X.duration("7 weeks")
    assert X.reply('```json\n{"a": 1}\n```') == {"a": 1} and X.reply('so: {"a": 2} ok') == {"a": 2} and X.reply("none") is None and X.reply(None) is None
    assert X.reply('{"results": [1]}', many=True) == [1] and X.reply("x [1, 2] y", many=True) == [1, 2] and X.reply('{"a": 1}', many=True) is None
    assert X.numbered("1. one\n3) three", 3) == ["one", None, "three"]
    blob = b"\x04\x0bstreamtyped..NSString\x01\x94\x84\x01+" + bytes([2]) + b"hi" + b"\x86"
    long = b"\x04\x0bstreamtypedNSString\x01\x94\x84\x01+\x81" + (300).to_bytes(2, "little") + b"x" * 300
    df = spark.createDataFrame([(blob,), (long,), (b"other",), (None,), (blob[:-2],)], "b binary")
    assert [r[0] for r in df.select(X.decoded_body("b")).collect()] == ["hi", "x" * 300, None, None, None]
    names = spark.createDataFrame([("Ann Lee", "Lee Ann"), ("Ann", "Zdeno Novák")], "a string, b string")
    assert [r[0] for r in names.select(X.same_person(F.col("a"), F.col("b"))).collect()] == [True, False]
    assert [r[0] for r in names.limit(1).select(X.people_search_url(F.col("a"), F.lit("Acme"))).collect()] == [X.search_url("Ann Lee", "Acme")]


def test_state(spark, tmp_path):
    T.save_kpis(spark.range(3), f"{tmp_path}/k")
    assert T.load_kpis(spark, f"{tmp_path}/k").count() == 3
    T.save_kpis(spark.range(3), f"{tmp_path}/k2", 2)
    with pytest.raises(ValueError):
        T.load_kpis(spark, f"{tmp_path}/k2")
    (tmp_path / "l.json").write_text('["a",\n "b", "a"]')
    (tmp_path / "m.json").write_text('{"a": "1"}')
    assert {r.value for r in T.reference_values(spark, f"{tmp_path}/l.json").collect()} == {"a", "b"}
    assert {r.value for r in T.reference_values(spark, f"{tmp_path}/none.json", ["s"]).collect()} == {"s"}
    assert T.reference_map(spark, f"{tmp_path}/m.json").first().value == "1"
    (tmp_path / "g.json").write_text('{"resourceName": "g/1", "name": "vip", "groupType": "USER_CONTACT_GROUP", "members": ["a", "b"]}\n{"resourceName": "g/2", "name": "all", "groupType": "SYSTEM", "members": ["a"]}')
    groups, members = T.groups_and_members(spark, f"{tmp_path}/g.json")
    assert groups.count() == 2 and members.count() == 2
    c = spark.createDataFrame([("a", [("old", "t")]), ("b", None)], "resourceName string, biographies array<struct<value: string, contentType: string>>")
    T.notes_snapshot(c, f"{tmp_path}/notes")
    now = spark.createDataFrame([("a", [("new", "t")])], c.schema)
    assert tuple(T.notes_to_restore(spark, f"{tmp_path}/notes", now).first()) == ("a", "biographies[0].value", "new", "old")
    assert T.contact(c, "a").count() == 1
