from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolodyne.functions import masks, names, notes, similarity
from rolodyne.functions import text as T
from rolodyne.operators.rules import company_case, org_matches, phone
from rolodyne.streaming.ingest import channel_of, handle_kind


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_folding_and_case(spark):
    assert column(spark, ["Ľubomír Šťastný", "Straße", "Ærø", None, "łódź"], lambda c: T.fold(T.text(c))) == ["Lubomir Stastny", "Strasse", "AEro", "", "lodz"]
    assert column(spark, ["JOHN VAN DER BERG", "anna-maria de la cruz", ""], T.title_case) == ["John van der Berg", "Anna-Maria de la Cruz", ""]
    assert column(spark, ["ABC", "A", "Ab", "ÁÉ", "12", None], T.is_all_caps) == [True, False, False, True, False, False]
    assert column(spark, ["abc", "漢字"], T.is_all_lower) == [True, False]
    assert column(spark, ["  a \t b\n"], T.squeeze) == ["a b"]


def test_extraction(spark):
    assert column(spark, ["x a.b@c.org, D@E.COM!", None], T.emails_in) == [["a.b@c.org", "D@E.COM"], []]
    assert column(spark, ["see https://a.b/c?d=1) and http://x.y"], T.urls_in) == [["https://a.b/c?d=1", "http://x.y"]]
    found = column(spark, ["call +421 903 123 456 or 0903 123 456, again +421903123456"], T.phones_in)[0]
    assert [T_ for T_ in found][0].startswith("+421") and len(found) == 2
    assert column(spark, ["#Lead and #Čaj_1 #lead"], T.hashtags) == [["lead", "čaj_1"]]
    ids = column(spark, ["IČO: 12345678, DIČ: 1234567890, IČ DPH: SK1234567890", "none"], T.legal_ids)
    assert tuple(ids[0]) == ("12345678", "1234567890", "SK1234567890") and tuple(ids[1]) == (None, None, None)
    assert column(spark, ["CN=Ann Lee/O=Acme"], T.distinguished_name) == [{"CN": "Ann Lee", "O": "Acme"}]


def test_mail_and_codes(spark):
    got = column(spark, [" A.B@C.SK ", "bad@", "a..b@c.sk", None], T.clean_email)
    assert [tuple(x) for x in got] == [("a.b@c.sk", 0.95, True), ("bad@", 0.5, False), ("a..b@c.sk", 0.5, False), ("", 0.5, False)]
    assert column(spark, ["x@acme.sk", "x@gmail.com", "none", "x@a.sk"], T.company_domain) == ["acme.sk", None, None, None]
    assert [tuple(x) if x else None for x in column(spark, ["ann.lee7@x.y", "a.lee@x.y", "info@x.y"], T.name_from_email)] == [("Ann", "Lee"), None, None]
    assert [tuple(x) for x in column(spark, ["94901", "110 00", "12"], T.postal_code)] == [("949 01", "SK"), ("110 00", "CZ"), ("12", "")]


def test_phones(spark):
    got = column(spark, ["0903 123 456", "+420 601 123 456", "02/123 456 78", "00421903123456", "+44 20 7946 0958", "12", None], phone)
    assert [g.e164 for g in got] == ["+421903123456", "+420601123456", "+421212345678", "+421903123456", "+442079460958", None, None]
    assert [g.kind for g in got] == ["mobile", "mobile", "fixed_line", "mobile", "unknown", "unknown", "unknown"]


def test_times_and_ids(spark):
    assert column(spark, [0, 86_400_000_000_000], lambda c: F.date_format(T.apple_time(c), "yyyy-MM-dd"), "bigint") == ["2001-01-01", "2001-01-02"]
    assert column(spark, [86_400_000_000_000], lambda c: T.to_apple_time(T.apple_time(c)), "bigint") == [86_400_000_000_000]
    ids = column(spark, ["a", None], lambda c: T.short_id(c, F.lit("x")))
    assert len(ids[0]) == 16 and ids[0] != ids[1]
    assert column(spark, ["x" * 600, "short"], lambda c: F.length(T.truncate(c))) == [500, 5]
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "no"], lambda c: T.parse_instant(c).cast("long")) == [1704067200, 1704067200, None]


def test_urls(spark):
    assert column(spark, ["https://www.Acme.sk/x", "nothing"], T.url_host) == ["acme.sk", ""]
    assert column(spark, ["https://netflix.com", "https://github.com/a", "https://a.b"], T.url_type) == ["twitter", "github", "website"]
    assert column(spark, ["http://LinkedIn.com/in/Ann-Lee/?x=1", "http://linkedin.com/company/x"], T.profile_url) == ["https://www.linkedin.com/in/ann-lee", None]
    assert column(spark, ["slackgo.T07", "beepergo.sms", "matrix-x", "WhatsApp", "linkedin", "other"], channel_of) == ["slack", "sms", "x", "whatsapp", "linkedin_dm", "other"]
    assert column(spark, ["a@b.cz", "+421 903 123 456", "ann"], handle_kind) == ["email", "phone", "handle"]
    orgs = F.array(F.lit("Acme, s.r.o."), F.lit("Tatra banka"))
    assert column(spark, ["acme", "banka", "xy", "other"], lambda c: org_matches(orgs, c)) == [True, True, False, False]
    assert column(spark, ["ACME SLOVAKIA SRO", "first company a. s.", "IBM"], company_case) == ["ACME Slovakia s.r.o.", "First Company a.s.", "IBM"]


def test_masks(spark):
    assert column(spark, ["mail ann.lee@acme.com now"], masks.mask_email) == ["mail a***@a***.com now"]
    assert column(spark, ["+421 903 123 456", "1", None], masks.mask_phone) == ["+*** *** *** *56", "1", ""]
    assert column(spark, ["Ann Mary Lee"], masks.mask_last_name) == ["Ann L."]
    assert column(spark, ["https://a.b/c/d?e"], masks.mask_url) == ["https://a.b/***"]
    assert column(spark, ["urls[0].value"], lambda c: masks.mask_field(c, F.lit("https://a.b/c"))) == ["https://a.b/***"]


def plain_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_bit_parallel_lcs(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)


def test_native_ratio(spark):
    r = random.Random(4)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randrange(9))), "".join(r.choice("abc ") for _ in range(r.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r"), similarity.fast_ratio("a", "b").alias("f"), similarity.ratio_bound(F.col("a"), F.col("b")).alias("u")).collect():
        n = len(row.a) + len(row.b)
        want = 200.0 * plain_lcs(row.a, row.b) / n if n else 100.0
        assert abs(row.r - want) < 1e-9 and abs(row.f - want) < 1e-9 and row.u >= want - 1e-9


def test_weighted_ratio():
    assert similarity.weighted("Ann Lee", "ann lee") == 100.0
    assert similarity.weighted("Lee Ann", "Ann Lee") == 95.0
    assert similarity.weighted("", "x") == 0.0
    assert similarity.weighted("Ann", "Ann Lee of Acme company") >= 80
    assert similarity.weighted("Ann Lee", "Zdenko Horvat") < 60


def test_name_steps():
    new = lambda n, orgs=(): [(c["field"].rpartition(".")[2], c["new"], c["confidence"]) for c in names.propose(n, list(orgs))]
    assert names.split_name("Ing. Ann Mary Lee PhD.") == ("Ann", "Mary Lee", "Ing. PhD.")
    assert ("givenName", "Ann", 0.85) in new({"displayName": "Ann Lee"})
    assert ("familyName", "Lee", 0.80) in new({"familyName": "Ann Lee"})
    assert ("familyName", "Lee", 0.80) in new({"givenName": "Ann Lee"})
    assert ("honorificPrefix", "Ing.", 0.90) in new({"givenName": "Ing. Ann", "familyName": "Lee"})
    assert ("givenName", "Ann", 0.95) in new({"givenName": "ANN", "familyName": "Lee"})
    assert ("familyName", "Nováková", 0.65) in new({"givenName": "Ann", "familyName": "Novakova"})
    assert new({"givenName": "Tomas", "familyName": "Smith"}) == []
    assert ("givenName", "Tomáš", 0.95) in new({"givenName": "Tomas", "familyName": "Malý"})
    assert ("familyName", "Lee", 0.85) in new({"displayName": "Ann Lee", "givenName": "Ann", "familyName": "Acme"}, ["Acme"])
    assert ("familyName", "Lee", 0.92) in new({"displayName": "Ann Lee | Acme", "givenName": "Ann", "familyName": "s.r.o."})
    assert ("familyName", "Lee", 0.90) in new({"givenName": "Ann", "middleName": "Lee", "familyName": "(ABC a.s.)"})
    assert ("familyName", "Lee", 0.95) in new({"displayName": "CN=Ann Lee/O=Acme"})
    assert names.propose(None, []) == [] and names.propose({}, []) == []
    assert names.accents("Marian", {"marian": "Marian"}) == ("Marian", 0.0)


def plain_dates(note, latest_year):
    import re

    out = []
    for pattern, (y, m, d) in T.DATES:
        for found in re.finditer(pattern, note or ""):
            year, month, day = (int(found[k]) for k in (y, m, d))
            if 1 <= month <= 12 and 1 <= day <= 31 and 1900 <= year <= latest_year:
                near = note[max(0, found.start() - 40) : found.end() + 20].lower()
                kind = next((name for name, marks in T.OCCASIONS if any(x in near for x in marks)), "unknown")
                out.append((found[0], f"{year:04d}-{month:02d}-{day:02d}", kind))
    return out


def test_dates_in_notes(spark):
    import random

    r = random.Random(2)
    pieces = ["born ", "1.2.1980", " 2001-13-01", "wedding ", " 5/6/2010", "3.3.1800", " name day ", "7-8-1999", "výročie ", "x" * 45, " and ", "\n", "12. 12. 2012", "2024-02-30", "31/31/2000", "1999", "é"]
    notes_ = ["born 1.2.1980, wedding 2001-13-01, anniversary 5/6/2010, 3.3.1800", None, "", *("".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(notes_)), "i int, note string").select("i", T.dates_in(F.col("note"), 2024).alias("d")).collect()
    assert {x.i: [tuple(d) for d in x.d] for x in rows} == {i: plain_dates(n, 2024) for i, n in enumerate(notes_)}
    assert [(d[1], d[2]) for d in plain_dates(notes_[0], 2024)] == [("1980-02-01", "birthday"), ("2010-06-05", "anniversary")]


BLOCK = "── Activity (auto · 2024-01-31) ──\nbody\n── End Activity ──"


def test_note_blocks(spark):
    assert notes.merge("", BLOCK, "Activity") == BLOCK
    once = notes.merge("free text", BLOCK, "Activity")
    assert once == BLOCK + "\n\nfree text" and notes.merge(once, BLOCK, "Activity") == once
    assert notes.strip(once, "Activity").strip() == "free text"
    other = "── CRM ──\nx\ny\n\nfree"
    both = notes.merge(other, BLOCK, "Activity")
    assert both == "── CRM ──\nx\ny\n\n" + BLOCK + "\n\nfree" and notes.merge(both, BLOCK, "Activity") == both
    endless = "── Activity (auto) ──\n" + "\n".join("x" * 30)
    assert notes.strip(endless, "Activity") == endless
    assert column(spark, ["free text", once], lambda c: notes.needs_update(c, F.lit(BLOCK), "Activity")) == [True, False]


def test_activity_block(spark):
    df = spark.createDataFrame([("whatsapp", 12, 4, "2024-01-29 10:00:00", "2024-01-20 10:00:00", "mine", 4), (None, 0, 0, None, None, None, 0)], "channel_primary string, messages long, n_channels int, i string, o string, awaiting_side string, stale_sent long")
    df = df.withColumns({"last_inbound_ever": F.col("i").cast("timestamp"), "last_outbound_ever": F.col("o").cast("timestamp")})
    a, b = [r.b for r in df.select(notes.activity_block("Activity", "2024-01-31 12:00:00").alias("b")).collect()]
    assert a.splitlines()[1:3] == ["Primary: WA · 30d: 12 msgs · 4 channels", "Last heard: 2024-01-29 WA · Awaiting: my reply (2d) · Stale sent: 4"]
    assert "No recent activity" in b


def test_other_blocks(spark):
    df = spark.createDataFrame([("2024-01-01", "Hello", None, None, "won", ["a", "b"], " n ")], "d string, s string, m string, t string, stage string, tags array<string>, notes string")
    mail, card = df.select(notes.interaction_body(F.col("d"), F.col("s"), F.col("m"), F.col("t")), notes.block("CRM", "2024-01-31", notes.state_body(F.col("stage"), F.col("tags"), F.col("notes")))).first()
    assert mail == "Email: 2024-01-01 – Hello"
    assert card.splitlines()[1:4] == ["Stage: won", "Tags: a, b", "Notes: n"]
    long = spark.range(1).select(notes.block("X", "2024-01-31", F.lit("y" * 900))).first()[0]
    assert len(long) <= notes.LONGEST and "…" in long
