from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolodyne.operators import activity as A
from rolodyne.operators import apply as P
from rolodyne.operators import audit as U
from rolodyne.operators import feedback as B
from rolodyne.operators import resolve as R
from rolodyne.operators import rules
from rolodyne.operators import scoring as S
from rolodyne.schemas import CONTACT

AS_OF = "2024-06-01 12:00:00"


def events(spark, rows):
    """rows: (contact, hours before as_of, direction, channel, thread, body)."""
    at = datetime(2024, 6, 1, 12)
    data = [(c, i, (at - timedelta(hours=h)).isoformat(), d, ch, t, b) for i, (c, h, d, ch, t, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "contact_id string, event_id long, at string, direction string, channel string, thread_id string, body string")
    return df.withColumn("ts", F.col("at").cast("timestamp"))


def bonus_of(spark, rows):
    k = A.engagement_bonus(A.contact_kpis(events(spark, rows), AS_OF, (30, 90, 365), A.KEYWORDS), AS_OF)
    return k.collect()


def test_hot_contact(spark):
    rows = [("a", 30 - i, "inbound", ["whatsapp", "email", "signal"][i % 3], "t", "a contract and an offer") for i in range(6)] + [("a", 40, "outbound", "email", "t", "hi")]
    k = bonus_of(spark, rows)[0]
    assert (k.messages_in, k.messages_out, k.awaiting_side, k.bonus) == (6, 1, "mine", 40.0) and k.keyword_hits == 12


def test_stale_contact(spark):
    rows = [("a", 250 * 24, "inbound", "email", "t0", "")] + [("a", 24 * (10 + i), "outbound", "email", f"t{i}", "") for i in range(1, 5)]
    k = bonus_of(spark, rows)[0]
    assert (k.stale_sent, k.awaiting_side, k.bonus) == (4, "theirs", -20.0)


def test_no_events(spark):
    assert bonus_of(spark, []) == []


def test_reply_lag(spark):
    rows = [("a", h, d, "email", "t", "") for h, d in ((100, "inbound"), (96, "outbound"), (80, "inbound"), (78, "outbound"), (50, "inbound"), (49, "outbound"))]
    got = {r.side: (r.pairs, r.median_lag_hours) for r in A.reply_lags(events(spark, rows), AS_OF, 30).collect()}
    assert got["mine"] == (3, 2.0) and got["theirs"] == (2, None)


def test_pairs_share_a_response_and_skip_none(spark):
    rows = [("a", 10, "inbound", "c", "t", ""), ("a", 9, "inbound", "c", "t", ""), ("a", 8, "outbound", "c", "t", ""), ("a", 7, "inbound", "c", "t", ""), ("a", 7, "outbound", "c", "t", "")]
    pairs = A.response_pairs(events(spark, rows), "inbound", "outbound", ["contact_id", "thread_id"])
    assert pairs.count() == 2  # the third response has the same instant


def test_kpi_map_and_first_last(spark):
    k = A.window_kpis(events(spark, [("a", 5, "inbound", "x", "t", ""), ("a", 24 * 60, "outbound", "y", "t", "")]), AS_OF)
    w = A.kpi_map(k).first().windows
    assert w["30d"].messages_in == 1 and w["90d"].channels == ["x", "y"] and w["365d"].messages_out == 1


def test_mass_events(spark):
    df = spark.createDataFrame([(["a"] * 11, "x", "a@b"), (["a"], "Weekly Newsletter", "@" * 11), (["a"], "lunch", None)], "att array<string>, title string, rec string")
    assert [tuple(r) for r in df.select(A.mass_event(F.col("att"), F.col("title")), A.mass_mail(F.col("rec"))).collect()] == [(True, False), (True, True), (False, False)]


CONTACTS = [
    {"resourceName": "people/1", "names": [{"displayName": "ANN LEE"}], "phoneNumbers": [{"value": "0903123456"}, {"value": "+421 903 123 456", "type": "mobile"}], "emailAddresses": [{"value": "Ann@Acme.SK"}], "addresses": [{"streetAddress": "Main 1", "city": "Nitra", "postalCode": "94901"}], "organizations": [{"name": "ACME SRO"}], "urls": [{"value": "http://acme.sk"}], "biographies": [{"value": "tel 0911 222 333"}]},
    {"resourceName": "people/2"},
    {"resourceName": "people/3", "names": [{"displayName": "Bob"}], "emailAddresses": [{"value": "me@own.sk"}, {"value": "bob@x.sk"}]},
]


def contacts(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", CONTACT).alias("c")).select("c.*")


def test_rules(spark):
    got = {(r.resource_name, r.field, r.new) for r in rules.analyse(contacts(spark, CONTACTS), owner=["me@own.sk"]).collect()}
    for want in [
        ("people/1", "phoneNumbers[0].value", "+421 903 123 456"),
        ("people/1", "phoneNumbers[0].type", "mobile"),
        ("people/1", "phoneNumbers[1]", "__DUPLICATE__"),
        ("people/1", "emailAddresses[0].value", "ann@acme.sk"),
        ("people/1", "addresses[0].postalCode", "949 01"),
        ("people/1", "addresses[0].country", "Slovensko"),
        ("people/1", "organizations[0].name", "ACME s.r.o."),
        ("people/1", "urls[0]", ""),
        ("people/1", "phoneNumbers[+]", "+421 911 222 333"),
        ("people/2", "contact", "__TO_BE_DELETED__"),
        ("people/3", "emailAddresses[0]", ""),
    ]:
        assert want in got


def test_shared_addresses(spark):
    rows = [{"resourceName": f"p/{i}", "addresses": [{"streetAddress": "Main 1", "city": " NITRA "}]} for i in range(5)] + [{"resourceName": "p/9", "addresses": [{"formattedValue": "else"}]}]
    got = rules.shared_address_rule(contacts(spark, rows)).collect()
    assert len(got) == 5 and {r.change.confidence for r in got} == {0.80}


def test_apply_and_empty_tables(spark):
    c = contacts(spark, CONTACTS)
    changes = rules.analyse(c).where("actionable and reason <> 'name extracted from display name'")
    after = {r.resourceName: r for r in P.apply_changes(c, changes).collect()}
    one = after["people/1"]
    assert one.phoneNumbers[0].value == "+421 903 123 456" and one.phoneNumbers[0].type == "mobile" and len(one.phoneNumbers) == 3
    assert one.urls == [] and one.names[0].givenName == "Ann" and after["people/2"].names is None
    empty = c.limit(0)
    assert rules.analyse(empty).count() == 0 and P.apply_changes(empty, changes.limit(0)).count() == 0


MAIN_PART = {"addresses": "formattedValue", "names": "givenName", "organizations": "name"}


def plain_apply(person, changes):
    """A contact after its changes, with lists and dicts."""
    import copy
    import re

    out, removed = copy.deepcopy(person), []
    arrays = {f.name: [p.name for p in f.dataType.elementType] for f in SCHEMA if f.name != "resourceName"}
    for c in changes:
        found = re.fullmatch(r"([A-Za-z]+)\[(\+|\d+)\](?:\.([A-Za-z]+))?", c["field"] or "")
        name = found and P.ALIASES.get(found[1], found[1])
        if name not in arrays:
            continue
        out[name] = out.get(name) or []
        here, at, extra = out[name], found[2], c.get("extra") or {}
        part = found[3] if found[3] not in (None, "value") else MAIN_PART.get(name, "value")
        if at == "+":
            if name in ("birthdays", "events"):
                entry = None
                for text in (extra.get("date"), c["new"]):
                    if entry is None and text and re.fullmatch(r"\d+-\d+-\d+", text):
                        entry = {"date": dict(zip(("year", "month", "day"), map(int, text.split("-"))))}
                    elif entry is None and text and text.startswith("{"):
                        entry = {"date": json.loads(text)}
            elif name == "userDefined":
                entry = {"key": extra.get("key", ""), "value": extra.get("value", c["new"])}
            else:
                entry = {part: c["new"]} if part in arrays[name] else {}
            if entry is not None and name in ("phoneNumbers", "emailAddresses", "urls", "addresses", "events"):
                entry = {"type": extra.get("type", "other")} | entry
            if name == "names" and here:
                here[0].update(entry)
            elif entry is not None:
                here.append(entry)
        elif int(at) < len(here):
            if c["new"] == "" and found[3] is None:
                removed.append((name, int(at)))
            elif part in arrays[name] and part != "date":
                here[int(at)][part] = c["new"]
    for name in {n for n, _ in removed}:
        out[name] = [e for k, e in enumerate(out[name]) if (name, k) not in removed]
    return out


SCHEMA = None  # of contacts, known once there is a session


def test_apply_equals_a_plain_form(spark):
    """Random change lists over random contacts, as columns and as dicts."""
    import random

    global SCHEMA
    r, rows, changes = random.Random(9), [], []
    SCHEMA = contacts(spark, CONTACTS).schema
    paths = ["names", "name", "phones", "emailAddresses", "address", "organizations", "url", "birthdays", "event", "userDefined", "notes", "nicknames", "unknown"]
    subs = ["", "", ".value", ".type", ".givenName", ".city", ".key", ".nothing", ".date", ".title"]
    extras = [None, {"type": "work"}, {"key": "k", "value": "v"}, {"date": "1980-05-06"}, {"date": '{"month": 5, "day": 6}'}, {"date": "soon"}]
    for k in range(60):
        person = {"resourceName": f"people/{k}"}
        for f in SCHEMA:
            if f.name != "resourceName" and r.random() < 0.6:
                parts = [p.name for p in f.dataType.elementType if p.name != "date"]
                person[f.name] = [{p: r.choice(["a", "b", ""]) for p in parts if r.random() < 0.7} for _ in range(r.randrange(4))]
        rows.append(person)
        own = [{"field": f"{r.choice(paths)}[{r.choice(['+', '0', '1', '2', '9'])}]{r.choice(subs)}", "new": r.choice(["x", "y", "", "2001-02-03", None]), "extra": r.choice(extras)} for _ in range(r.randrange(9))]
        own += [{"field": r.choice(["names", "names[x]", "", None]), "new": "z", "extra": None}]
        changes.append((person, own))
    flat = [(p["resourceName"], s, c["field"], c["new"], c["extra"]) for p, own in changes for s, c in enumerate(own)]
    r.shuffle(flat)
    df = spark.createDataFrame(flat, "resource_name string, seq long, field string, new string, extra map<string,string>")
    table = contacts(spark, rows).withColumns({"_todo_": F.lit("own"), "part": F.lit("own"), "seq": F.lit(1)})
    got = P.apply_changes(table, df)
    want = contacts(spark, [plain_apply(p, own) for p, own in changes])
    assert {x.resourceName: x for x in got.select(*want.columns).collect()} == {x.resourceName: x for x in want.collect()}
    assert {x.part for x in got.collect()} == {"own"} and got.columns == table.columns
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert P.apply_changes(table, df.limit(0)).count() == 60


def test_a_birthday_has_its_date_in_extra(spark):
    person = contacts(spark, [{"resourceName": "p"}])
    changes = spark.createDataFrame([("p", 1, "birthdays[+]", "6 May", {"date": "1980-05-06"}), ("p", 2, "birthdays[+]", "2001-02-03", None), ("p", 3, "birthdays[+]", "never", None)], "resource_name string, seq long, field string, new string, extra map<string,string>")
    assert [tuple(b.date) for b in P.apply_changes(person, changes).first().birthdays] == [(1980, 5, 6), (2001, 2, 3)]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "Ann Lee", ["+421903123456"], ["x@y.z"]), ("b", "Bob", ["0903 123 456"], ["X@Y.z"]), ("c", "Anne Lee", [], []), ("d", "Ann Lée", [], []), ("e", None, [], [])], "resource_name string, display_name string, phones array<string>, emails array<string>")
    got = {(r.a, r.b): (r.match_type, r.confidence) for r in R.duplicates(df).collect()}
    assert got[("a", "b")] == ("phone", 0.9) and got[("a", "d")] == ("name", 1.0) and got[("a", "c")][0] == "name" and len(got) == 4


def test_one_to_one(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(1, 10, 90.0), (1, 11, 80.0), (2, 10, 95.0), (3, 11, 70.0)], "id long, key long, score double")
    assert {(r.id, r.key) for r in R.assign_one_to_one(df).collect()} == {(2, 10), (1, 11)}
    assert R.assign_one_to_one(df.limit(0)).count() == 0


def test_lookup_order(spark):
    records = spark.createDataFrame([("r1", ["A@B.c"], ["0903 123 456"], ["h"]), ("r2", [], ["+421903123456"], []), ("r3", [], [], ["https://linkedin.com/in/Ann"]), ("r4", [], [], [])], "record string, emails array<string>, phones array<string>, handles array<string>")
    index = spark.createDataFrame([(1, "a@b.c", "c1", 1), (1, "a@b.c", "c2", 2), (2, "903123456", "c3", 1), (5, "ann", "c4", 1)], "rule int, key string, contact string, seq int")
    assert {r.record: r.contact for r in R.ranked_lookup(R.record_candidates(records), index).collect()} == {"r1": "c1", "r2": "c3", "r3": "c4"}


def test_tags(spark):
    t = spark.createDataFrame([("vip",), ("Kolégovia",), ("investor",), ("new tag",)], "tag string")
    n = spark.createDataFrame([("Very important",), ("Kolegovia",), ("Investors",)], "name string")
    a = spark.createDataFrame([("VIP", "Very important")], "alias string, name string")
    assert {r.tag: (r.group_name, r.route) for r in R.resolve_tags(t, n, a).collect()} == {"vip": ("Very important", "alias"), "Kolégovia": ("Kolegovia", "equal"), "investor": ("Investors", "similar"), "new tag": ("New Tag", "create")}


def test_review_merge(spark):
    cols = "resource_name string, field string, seq int, old string, new string, confidence double, reason string"
    r = spark.createDataFrame([("p", "a", 1, "o", "n1", 0.7, "r"), ("p", "a", 2, "o", "n2", 0.8, "r"), ("p", "b", 3, "o", "n", 0.7, "r"), ("p", "c", 4, "o", "n", 0.7, "r")], cols)
    v = spark.createDataFrame([("p", "a", None, "better", None, None), ("p", "b", None, None, 0.0, None), ("p", "d", "o", "x", 0.9, "new")], "resource_name string, field string, old string, new string, confidence double, reason string")
    assert {(x.field, x.new, x.confidence) for x in B.merge_review(r, v).collect()} == {("a", "better", 0.8), ("c", "n", 0.7), ("d", "x", 0.9)}


def test_bayes_limits(spark):
    df = spark.createDataFrame([("a", "approved")] * 200 + [("b", "rejected")] * 100 + [("c", "approved")] * 4, "category string, decision string")
    assert {r.category: r.confidence for r in B.rule_stats(df).collect()} == {"a": 0.98, "b": 0.30, "c": None}


def test_candidates_and_scores(spark):
    rows = [("old", "x", 70.0, 2, None, False, False), ("recent", "x", 2.0, 2, None, False, False), ("fits", "x", 12.0, 2, None, False, False), ("job", "x", 70.0, 0, "job_change", False, False), ("own", "x", 12.0, 2, None, False, True), ("live", "x", None, 0, None, True, False), ("undated", "x", None, 2, None, False, False), ("", "x", 12.0, 2, None, False, False)]
    df = spark.createDataFrame([(n, s if g is not None else None, g, i, sig, a, o) for n, s, g, i, sig, a, o in rows], "name string, last_date string, months_gap double, interactions int, signal string, active boolean, own boolean")
    assert {r.name for r in S.candidates(df).collect()} == {"fits", "job", "live"}
    full = S.candidates(df).withColumns({"completeness": F.lit(4), "executive": F.lit(True), "personal": F.col("name") == "live", "bonus": F.lit(-20.0)})
    got = {r.name: r.score_total for r in S.follow_up_scores(full).collect()}
    assert got == {"fits": 27.0, "job": 33.0, "live": 0.9}


def test_personal_and_signals(spark):
    df = spark.createDataFrame([(["a@gmail.com"],), (["a@acme.sk"],), ([],), (["none"],)], "e array<string>")
    no = F.lit(False)
    assert [r[0] for r in df.select(S.likely_personal(no, no, F.lit(""), F.col("e"))).collect()] == [True, False, True, False]
    kinds = spark.createDataFrame([("job_change", "short"), ("job_change", "a headline that is long"), ("active", None)], "k string, h string")
    assert [r[0] for r in kinds.select(S.signal_type(F.col("k"), F.col("h"))).collect()] == ["profile", "job_change", "active"]


def test_crm_state(spark):
    state = spark.createDataFrame([("a", "inbox", "d0"), ("b", "won", "d0")], "id string, stage string, changed_at string")
    up = spark.createDataFrame([("a", "inbox", "d1"), ("b", "lost", "d1"), ("c", "inbox", "d1")], "id string, stage string, at string")
    assert {tuple(r) for r in S.upsert_stage(state, up).collect()} == {("a", "inbox", "d0"), ("b", "lost", "d1"), ("c", "inbox", "d1")}
    assert {r.changed_at for r in S.upsert_stage(state, up, True).collect()} == {"d1"}


def test_audit_invariants(spark):
    rows = [(f"p{i % 7}", "f", i, str(i), str(i + 1), 0.3 + 0.1 * (i % 8), "r") for i in range(60)]
    ch = spark.createDataFrame(rows, "resource_name string, field string, seq int, old string, new string, confidence double, reason string")
    s = U.contact_stats(ch).collect()
    assert all(r.high + r.medium + r.low == r.total for r in s) and sum(r.total for r in s) == 60
    assert U.change_hash(ch).collect() and U.changed_since(ch, U.change_hash(ch.where(U.band(F.col("confidence")) == "medium"))).count() == 0
    log = ch.select(F.lit(None).cast("string").alias("type"), "resource_name", "confidence", F.lit(None).cast("int").alias("batch"), F.lit(None).cast("int").alias("success"), F.lit(None).cast("int").alias("failed"), "seq").withColumnRenamed("seq", "at")
    marks = spark.createDataFrame([("batch_end", None, None, 1, 3, 1, 100), ("batch_end", None, None, 1, 4, 0, 200)], log.schema)
    r = U.log_summary(log.unionByName(marks)).first()
    assert (r.changes, r.contacts, r.success, r.failed) == (60, 7, 4, 0)
    page = U.page(ch, [F.col("seq")], 2, 1)
    assert [x.seq for x in page.collect()] == [5, 6, 7, 8, 9]


@pytest.mark.parametrize("conf,want", [(0.90, "high"), (0.8999, "medium"), (0.60, "medium"), (0.5999, "low")])
def test_bands(spark, conf, want):
    assert spark.range(1).select(U.band(F.lit(conf))).first()[0] == want


def test_connections(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    left = spark.createDataFrame([(1, "Ann Lee", "A@x.y", ""), (2, "Lee Bob", "", "Acme"), (3, "Bob Lee", "", ""), (4, "Zoe", "", "")], "id long, name string, email string, org string")
    right = spark.createDataFrame([(10, 1, ["Other"], ["a@x.y"], ""), (11, 2, ["Ann Lee"], ["a@x.y"], ""), (12, 3, ["Bob Lee", "Bobby"], [], "Acme")], "key long, seq int, names array<string>, emails array<string>, org string")
    got = {r.id: (r.key, r.route) for r in R.match_connections(left, right, block=None).collect()}
    assert got == {1: (11, "email"), 2: (12, "company")}


def test_participants(spark):
    records = spark.createDataFrame([("r", ["Zdeno", "Ann Lée"]), ("s", ["Nobody"])], "record string, names array<string>")
    names = spark.createDataFrame([("c1", "Ann Lee"), ("c2", "Ann Leeds")], "contact string, name string")
    assert [(r.record, r.contact, r.score) for r in R.fuzzy_participants(records, names).collect()] == [("r", "c1", 100.0)]


def test_score_contacts(spark):
    c = spark.createDataFrame([("a", "Ann", ["a@x.sk", "b@x.sk"], True, "X", "CEO", ""), ("b", "Bob", ["b@gmail.com"], False, "", "", ""), ("c", "Own", ["c@own.sk"], True, "Own", "", ""), ("d", "Dan", [], False, "", "", "")], "id string, name string, emails array<string>, has_phone boolean, org string, title string, profile_url string")
    cache = spark.createDataFrame([("a@x.sk", "2023-01-01", None), ("b@x.sk", None, "2023-06-01"), ("b@gmail.com", "2023-06-01", ""), ("c@own.sk", "2023-06-01", None)], "email string, email_date string, meeting_date string")
    signals = spark.createDataFrame([("a", "active", "h", None)], "id string, signal_type string, headline string, current_role string")
    kpis = spark.createDataFrame([("d", 10.0, 3)], "id string, bonus double, active_30d long")
    got = S.score_contacts(c, cache, signals, kpis, "2024-06-01", ["own"], ["own.sk"]).collect()
    assert [(r["rank"], r.id) for r in got] == [(1, "a"), (2, "b"), (3, "d")]
    # gap 366 days: 2 kinds x 12.2 months + 10 + 4 x 2 + 15
    assert got[0].score_total == 57.4 and got[1].multiplier == 0.3 and got[2].bonus == 10.0
    assert S.all_mail_count(spark.createDataFrame([("a", "a@x.sk"), ("a", "b@x.sk")], "id string, email string"), cache).first().interactions == 2


def test_needs_review(spark):
    df = spark.createDataFrame([([(0.95,), (0.7,)],), ([(0.95,)],), ([],)], "c array<struct<confidence: double>>")
    assert [r[0] for r in df.select(P.needs_review(F.col("c"))).collect()] == [True, False, False]


def test_swapped_names_meet(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    left = spark.createDataFrame([(1, "Novak Jan", "", "")], "id long, name string, email string, org string")
    right = spark.createDataFrame([(10, 1, ["Jan Novak"], ["x@y.z"], "")], "key long, seq int, names array<string>, emails array<string>, org string")
    assert [(r.id, r.key, r.route) for r in R.match_connections(left, right).collect()] == [(1, 10, "name")]
    records = spark.createDataFrame([("r", ["Novak Jan"])], "record string, names array<string>")
    names = spark.createDataFrame([("c1", "Jan Novak"), ("c2", "Nora Vak")], "contact string, name string")
    assert [(r.record, r.contact) for r in R.fuzzy_participants(records, names).collect()] == [("r", "c1")]


def test_assignment_of_string_ids(spark, tmp_path):
    """Rounds and the last task give what a pass over the sorted pairs gives, also on a long chain."""
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(3)
    pairs = {(f"a{r.randrange(40)}", f"people/c{r.randrange(40)}"): float(r.randrange(80, 90)) for _ in range(250)}
    pairs |= {(f"x{k:03}", f"people/x{k + j:03}"): 100.0 - (2 * k + j) / 10 for k in range(60) for j in (0, 1)}
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "id string, key string, score double")
    for first_come in (False, True):
        used, want = set(), set()
        for (i, k), v in sorted(pairs.items(), key=lambda x: (x[0][0], -x[1], x[0][1]) if first_come else (-x[1], *x[0])):
            if ("i", i) not in used and ("k", k) not in used:
                used |= {("i", i), ("k", k)}
                want.add((i, k, v))
        for few in (R.FEW, 200):
            assert {tuple(x) for x in R.assign_one_to_one(df, first_come, few).collect()} == want
    empty = R.assign_one_to_one(df.limit(0))
    assert empty.count() == 0


def test_no_near_name_is_lost(spark):
    """The pairs that are compared hold all that reach the threshold, against every pair."""
    import random

    from rolodyne.functions.similarity import _name_score, weighted

    r = random.Random(5)
    parts = ["jan", "novak", "nowak", "anna", "lee", "li", "petrova", "peter", "o", "maria", "van", "der", "berg", "kovacova"]
    names = sorted({" ".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(60)} | {"jan novk", "noavk jan", "kovacov anna", "čeng 漢字"})
    a = spark.createDataFrame([(n,) for n in names], "na string")
    for least in (60.0, 85.0, 97.0):
        got = {tuple(x) for x in R.near_names(a, a.withColumnRenamed("na", "nb"), least).collect()}
        assert {(x, y) for x in names for y in names if _name_score(x, y) >= least} <= got
    records = spark.createDataFrame([(n, [n]) for n in names], "record string, names array<string>")
    contacts_ = spark.createDataFrame([(f"people/{n}", n) for n in names[::2]], "contact string, name string")
    got = {x.record: (x.contact, round(x.score, 6)) for x in R.fuzzy_participants(records, contacts_).collect()}
    from rolodyne.functions.text import compare_key

    fold = {x.n: x.k for x in a.select(F.col("na").alias("n"), compare_key(F.col("na")).alias("k")).collect()}
    for n in names:
        best = max(((round(weighted(fold[n], fold[m]), 6), m) for m in names[::2]), key=lambda x: x[0])[0]
        assert (got[n][1] == best if best >= 92 else n not in got)
