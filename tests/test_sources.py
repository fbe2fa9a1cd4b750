from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rolodyne.schemas import CONTACT
from rolodyne.sources import files as S
from rolodyne.sources import rest
from rolodyne.streaming import ingest as I


def test_snapshot_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(json.dumps({"resourceName": f"p/{i}", "names": [{"givenName": "Ann"}]}),) for i in range(5)], "j string").select(F.from_json("j", CONTACT).alias("c")).select("c.*")
    s = S.write_snapshot(c, f"{tmp_path}/snapshot-2024-01-01")
    assert s["ok"] and s["rows"] == 5
    S.write_snapshot(c, f"{tmp_path}/snapshot-2024-02-01")
    assert S.latest_path(spark, str(tmp_path), "snapshot").endswith("02-01") and S.latest_path(spark, str(tmp_path), "none") is None


def test_connections_and_domains(spark, tmp_path):
    (tmp_path / "c.csv").write_text('First Name , Last Name,Email Address\n Ann , Lee ,a@b.c\n,,x@y.z\n"Bo\nb",,\n')
    rows = S.read_connections(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.first_name, r.last_name) for r in rows] == [("Ann", "Lee"), ("Bo\nb", "")]
    (tmp_path / "d.txt").write_text("# list\nGmail.com\nbad domain\nx.y-z.sk\n")
    assert {r.value for r in S.read_domains(spark, str(tmp_path / "d.txt")).collect()} == {"gmail.com", "x.y-z.sk"}


def messages(spark, rows):
    df = spark.createDataFrame(rows, "interactionId string, ts string, summary string")
    return df.select("interactionId", F.col("ts").cast("timestamp").alias("timestamp"), "summary", F.lit("email").alias("channel"))


def test_partitions_are_idempotent(spark, tmp_path):
    path = f"{tmp_path}/messages"
    first = messages(spark, [("a", "2024-01-31 23:59:00", "x"), ("a", "2024-01-31 23:59:00", "x"), ("b", "2024-02-01 00:00:00", "y")])
    new = S.new_messages(first, path)
    assert new.count() == 2
    S.append_messages(new, path)
    assert S.new_messages(first, path).count() == 0
    more = messages(spark, [("c", "2024-02-02 00:00:00", "z"), ("a", "2024-01-31 23:59:00", "x")])
    S.append_messages(S.new_messages(more, path), path)
    assert S.read_messages(spark, path).count() == 3 and S.read_messages(spark, path, ["2024-02"]).count() == 2


def test_logs(spark, tmp_path):
    ch = spark.createDataFrame([("p", "f", "o", "n", "r", 0.9)], "resource_name string, field string, old string, new string, reason string, confidence double")
    S.write_log(ch, f"{tmp_path}/log", "s1", 1)
    log = S.read_log(spark, f"{tmp_path}/log")
    assert {r.type for r in log.collect()} == {"batch_start", "batch_end", None}


def test_session_payload(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"healthy": True, "chats": [{"id": "c", "network": "whatsapp", "messages": [{"id": "1", "timestamp": "2024-01-01T00:00:00Z", "text": "hi", "isSender": True}]}]}))
    assert S.read_session(spark, str(p)).first().direction == "outbound"
    p.write_text(json.dumps({"healthy": True, "chats": []}))
    with pytest.raises(ValueError):
        S.read_session(spark, str(p))
    assert S.read_session(spark, str(p), allow_empty=True).count() == 0


def test_response_shapes(spark):
    df = spark.createDataFrame([('[{"id": "1"}]',), ('{"items": [{"id": "2"}]}',), ('{"chats": [{"id": "3"}, {"id": "4"}]}',), ("{}",)], "j string")
    assert [r[0] for r in df.select(F.size(F.coalesce(S.items(F.col("j"), "chats", "struct<id: string>"), F.array()))).collect()] == [1, 1, 2, 0]


def test_paged_source(spark):
    def fetch(account, cursor):
        number = int(cursor or 0)
        rows = [(account, f"2024-01-{10 - number * 3 - k:02d}T00:00:00Z") for k in range(3)]
        return rows, str(number + 1) if number < 2 else None

    spark.dataSource.register(rest.paged_source("paged_test", fetch, "account string, at string"))
    df = spark.read.format("paged_test").option("accounts", "a,b").option("since", "2024-01-05T00:00:00Z").option("until", "2024-01-10T00:00:00Z").load()
    assert df.count() == 10 and df.rdd.getNumPartitions() == 2
    tries = []

    def flaky(account, cursor):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return [("x", "2024")], None

    assert list(rest.pages(flaky, "a", wait=0.0)) == [("x", "2024")] and len(tries) == 3


def test_paged_stream(spark, tmp_path):
    """A cursor for each account, one task each; the overlap brings late rows again, and only then."""
    stop = tmp_path / "upto"
    stop.write_text("3")
    path = str(stop)

    def fetch(account, cursor):
        upto = int(open(path).read()) - (2 if account == "slow" else 0)
        days = list(range(upto, 0, -1))
        at = int(cursor or 0)
        rows = [(account, f"2024-01-{d:02d}T00:00:00Z") for d in days[at : at + 2]]
        return rows, str(at + 2) if at + 2 < len(days) else None

    for name, overlap, want in (("paged_plain", 0, {("fast", d): 1 for d in range(1, 7)} | {("slow", d): 1 for d in range(1, 5)}), ("paged_late", 86400, {("fast", d): 1 + (d in (2, 3)) for d in range(1, 7)} | {("slow", d): 1 for d in range(1, 5)})):
        stop.write_text("3")
        spark.dataSource.register(rest.paged_source(name, fetch, "account string, at string"))
        out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
        for upto in (3, 6):
            stop.write_text(str(upto))
            stream = spark.readStream.format(name).option("accounts", "fast,slow").option("overlap", overlap).option("since", "2024-01-01T00:00:00Z").load()
            q = stream.writeStream.format("parquet").option("checkpointLocation", check).start(out)
            q.processAllAvailable()
            q.stop()
        got = {}
        for r in spark.read.parquet(out).collect():
            k = (r.account, int(r.at[8:10]))
            got[k] = got.get(k, 0) + 1
        assert got == want, name


def test_records_from_messages(spark):
    people = [{"handle": "+421 903 123 456", "name": "Ann", "self": False}, {"handle": "me@x.y", "name": "Me", "self": True}]
    df = spark.createDataFrame([("c", "slackgo.T1", "1", "2024-01-01", "", True, ["f"], people), ("c", "signal", "2", None, "lost", False, [], people), ("c", "signal", "3", "2024-01-02", " hi ", False, [], people)], "chat string, network string, id string, t string, text string, is_sender boolean, attachments array<string>, participants array<struct<handle: string, name: string, self: boolean>>")
    got = I.to_records(df.withColumn("ts", F.col("t").cast("timestamp"))).orderBy("timestamp").collect()
    assert [(r.channel, r.direction, r.summary) for r in got] == [("slack", "outbound", "[attachment]"), ("signal", "inbound", "hi")]
    assert got[0].matchCandidates.phones == ["+421 903 123 456"] and got[0].matchCandidates.emails == []


def test_stream_removes_duplicates_and_resumes(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "event_id long, ts timestamp, v string"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:00", "a"), (2, "2024-01-31 00:00:00", "b")], "event_id long, t string, v string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "v").write.parquet(f"{src}")
    run = lambda **k: I.run_ingest(I.deduplicated(I.read_stream(spark, src, schema)), f"{tmp_path}/out", f"{tmp_path}/state", **k)
    assert run(paused=True) is None
    run().awaitTermination()
    run().awaitTermination()  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert I.run_all({"bad": lambda: 1 / 0, "good": run}) == {"bad": "error: division by zero", "good": "ok"}


def test_windows_of_runs():
    assert I.window_of(None, None, "2024-01-10T00:00:00+00:00")[0] == "2024-01-09T00:00:00+00:00"
    assert I.window_of(None, "2024-01-09T12:00:00+00:00", "2024-01-10T00:00:00+00:00")[0] == "2024-01-09T11:55:00+00:00"
    assert I.window_of("2000-01-01T00:00:00+00:00", None, "2024-01-10T00:00:00+00:00")[0].startswith("2015-01-01")


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 20:02d} 0{i % 10}:00:00", "ab"[i % 2]) for i in range(200)]
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, "event_id long, t string, kind string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "kind").write.parquet(src)
    stream = I.windowed_counts(I.read_stream(spark, src, "event_id long, ts timestamp, kind string"), "ts", "1 day", "0 seconds", "kind")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window.start, r.kind): r.n for r in spark.table("windows").collect()}
    want = {(r.w.start, r.kind): r.n for r in spark.read.parquet(src).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and sum(got.values()) == 200


def test_learned_matches(spark):
    cache = spark.createDataFrame([("h1", "c1")], "handle string, contact_id string")
    batch = spark.createDataFrame([("h1", "c9", 1), ("h2", "c2", 2), ("h2", "c3", 1), (None, "c4", 1), ("h5", None, 1)], "handle string, contact_id string, ts int")
    learned = I.learn_matches(cache, batch)
    assert {r.handle: r.contact_id for r in learned.collect()} == {"h1": "c1", "h2": "c3"}
    new = spark.createDataFrame([("h2", None), ("h7", None)], "handle string, contact_id string")
    assert {r.handle: r.contact_id for r in I.known_contacts(new, learned).collect()} == {"h2": "c3", "h7": None}


def test_instants_of_any_spelling(spark, tmp_path):
    """Rows whose instants have a fraction, none, or another zone come in order and once."""
    assert rest.micros("2024-01-01T00:00:00Z") == rest.micros("2024-01-01T01:00:00.000+01:00") == rest.micros("2024-01-01T00:00:00") and rest.micros("junk") is None
    assert rest.micros("2024-01-01T00:00:00Z") < rest.micros("2024-01-01T00:00:00.500Z") < rest.micros("2024-01-01T00:00:03Z")
    stop = tmp_path / "upto"
    path, all_rows = str(stop), ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.500Z", "2024-01-01T01:00:03+01:00"]

    def fetch(account, cursor):
        return [(account, x) for x in reversed(all_rows[: int(open(path).read())])] + [(account, None)], None

    for name, overlap, want in (("spelled_plain", "0", [1, 1, 1]), ("spelled_late", None, [3, 2, 1])):
        spark.dataSource.register(rest.paged_source(name, fetch, "account string, at string"))
        out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
        for upto in (1, 2, 3):
            stop.write_text(str(upto))
            options = {"accounts": "a", "since": "2023-12-31T00:00:00Z"} | ({} if overlap is None else {"overlap": overlap})
            q = spark.readStream.format(name).options(**options).load().writeStream.format("parquet").option("checkpointLocation", check).start(out)
            q.processAllAvailable()
            q.stop()
        got = [r.at for r in spark.read.parquet(out).collect()]
        assert [got.count(x) for x in all_rows] == want, name  # by default five minutes are read again


@pytest.mark.parametrize("kind", ["string", "timestamp"])
def test_filters_reach_the_pages(spark, tmp_path, kind):
    """A where on the instant or the account changes what is fetched; counts come from the source."""
    from datetime import UTC, datetime

    log = str(tmp_path / "log")

    def fetch(account, cursor):
        with open(log, "a") as f:
            f.write(f"{account} {cursor}\n")
        n = int(cursor or 0)
        at = [datetime(2024, 1, 30 - 3 * n - k, 12, tzinfo=UTC) for k in range(3)]
        return [(account, n, x if kind == "timestamp" else x.isoformat().replace("+00:00", "Z")) for x in at], str(n + 1) if n < 8 else None

    def count(account, since, until):
        return 7 if (since, until) == (rest.micros("2024-01-05T00:00:00Z"), None) else -1

    spark.dataSource.register(rest.paged_source(f"pushed_{kind}", fetch, f"account string, page int, at {kind}", count))
    rows = rest.read_pages(spark, f"pushed_{kind}", accounts="a,b,c")
    at = lambda day: f"2024-01-{day:02d}T00:00:00Z" if kind == "string" else datetime(2024, 1, day, tzinfo=UTC)

    def fetched(df):
        open(log, "w").close()
        n = len(df.collect())
        return n, [x.split()[0] for x in open(log)]

    n, calls = fetched(rows)
    assert n == 81 and len(calls) == 27
    n, calls = fetched(rows.where((F.col("at") >= F.lit(at(25))) & (F.col("account") == "b")))
    assert n == 6 and set(calls) == {"b"} and len(calls) <= 4
    n, calls = fetched(rows.where(F.col("account").isin("a", "c") & (F.col("at") > F.lit(at(29))) & (F.col("at") < F.lit(at(30)))))
    assert n == 2 and len(calls) <= 4 and "b" not in calls
    assert fetched(rows.where((F.col("at") > F.lit(at(29))) & (F.col("at") < F.lit(at(10))))) == (0, [])
    counts = rest.count_rows(spark, f"pushed_{kind}", accounts="a,b", since="2024-01-05T00:00:00Z")
    open(log, "w").close()
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 7), ("b", 7)] and open(log).read() == ""


def test_updates_under_a_condition(spark, tmp_path):
    """Batches of the size asked for; changed tags are reported; a task that fails midway and runs again writes once."""
    import os

    store, log, failed = tmp_path / "store", str(tmp_path / "requests"), str(tmp_path / "failed")
    store.mkdir()
    for k in range(40):
        (store / f"p{k}").write_text(json.dumps({"tag": "t1" if k % 10 else "t9", "body": "old", "writes": 0}))
    folder, report = str(store), str(tmp_path / "report")

    def send(key, lot):
        out = []
        for i, tag, body in lot:
            entry = json.load(open(f"{folder}/{i}"))
            ok = entry["tag"] == tag or (entry["body"] == body and entry["tag"] == f"after {tag}")
            if entry["tag"] == tag:
                json.dump({"tag": f"after {tag}", "body": body, "writes": entry["writes"] + 1}, open(f"{folder}/{i}", "w"))
            out.append(ok)
        with open(log, "a") as f:
            f.write(f"{key} {len(lot)}\n")
        if not os.path.exists(failed):
            open(failed, "w").close()
            raise OSError("the answer is lost")
        return out

    spark.dataSource.register(rest.conditional_sink("updates", send, lambda n, conflicts: open(report, "w").write(json.dumps([n, conflicts]))))
    updates = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("t1").alias("tag"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("body"))
    rest.write_updates(updates, "updates", request="7")
    assert json.load(open(report)) == [36, ["p0", "p10", "p20", "p30"]]
    entries = {k: json.load(open(store / f"p{k}")) for k in range(40)}
    assert all(e["writes"] == (k % 10 > 0) and e["body"] == (f"new {k}" if k % 10 else "old") for k, e in entries.items())
    sizes = [int(x.split()[1]) for x in open(log)]
    assert max(sizes) == 7 and sum(sizes) > 40
    rest.write_updates(updates, "updates", request="7")  # all of it again: nothing is written twice
    assert all(json.load(open(store / f"p{k}"))["writes"] <= 1 for k in range(40)) and json.load(open(report))[0] == 36


def test_documents(spark, tmp_path):
    """A missing document is none, a broken one an error; writing replaces, and is tried again."""
    path = str(tmp_path / "state.json")
    assert S.read_document(spark, path) is None
    for k in (1, 2):
        S.write_document(spark, path, {"n": k, "name": "Žofia", "list": [{"a": k}]})
    row = S.read_document(spark, path).first()
    assert (row.n, row.name, row.list[0].a) == (2, "Žofia", 2)
    assert S.read_document(spark, path, "n long").first().n == 2
    (tmp_path / "bad.json").write_text('{"n": ')
    with pytest.raises(Exception):
        S.read_document(spark, str(tmp_path / "bad.json"), "n long").collect()
    with pytest.raises(Exception):
        S.write_document(spark, str(tmp_path / "bad.json" / "below"), {})
