"""Rules on customers made into contacts of many shapes; the SQL tells each rule again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes as N
from ..operators import outreach as O
from ..operators import resolve as R
from ..operators import rules
from ..schemas import CONTACT
from ..session import table
from ..streaming import ingest

#: Spellings of a number with the eight digits t, by the customer's key.
SPELLED = ["concat('09', t)", "concat('+4219', t)", "concat('00420 6', left(t, 2), ' ', right(t, 6))", "concat('+420-2', t)", "concat('02/', t)", "concat('+421 9', left(t, 2), ' ', substr(t, 3, 3), ' ', right(t, 3))", "concat('+44 7700 9', left(t, 5))", "left(t, 4)", "''", "concat('9', t)", "concat('(0', '9', left(t, 2), ') ', right(t, 6))", "concat('+421 5', left(t, 1), '/', right(t, 7))"]
_SPELLED = "CASE k % 12 " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(SPELLED)) + " END"
#: Addresses of pages, where s is the segment in lower case.
PAGES = ["concat('https://www.linkedin.com/company/x', k)", "concat('https://linkedin.com/in/person', k)", "concat('http://www.Yelp.com/biz/', k)", "concat('https://facebook.com/', s)", "concat('https://twitter.com/other', k)", "concat('https://www.', s, '.com')", "concat('https://', s, '.sk/about?x=1')", "concat('https://unrelated', k, '.com/')", "concat(s, '.com/')", "''", "concat(' https://WWW.LinkedIn.com/school/y', k, '/ ')", "concat('https://m.', s, '.eu/a/b')", "'https://www.crunchbase.com/'"]
_PAGES = "CASE k % 13 " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(PAGES)) + " END"


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers: k, the digits t, the segment s, and a contact of two numbers, a
    page, an organisation and a name."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0").alias("t"), F.lower("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n"))
    raw = c.select("*", F.expr(_SPELLED).alias("p"), F.expr(_PAGES).alias("u"))
    typed = F.when(F.col("k") % 5 == 0, F.lit("work"))
    contact = F.struct(
        F.concat(F.lit("people/c"), "k").alias("resourceName"),
        F.array(F.struct(F.col("p").alias("value"), typed.alias("type")), F.struct(F.when(F.col("k") % 4 == 0, F.col("p")).otherwise(F.concat(F.lit("09"), F.reverse("t"))).alias("value"), F.lit("mobile").alias("type"))).alias("phoneNumbers"),
        F.array(F.struct(F.col("u").alias("value"))).alias("urls"),
        F.array(F.struct(F.concat(F.initcap("s"), F.element_at(F.array(*map(F.lit, (" s.r.o.", " a.s.", "", " Group"))), (F.col("k") % 4 + 1).cast("int"))).alias("name"))).alias("organizations"),
        F.array(F.struct(F.element_at(F.array(F.lit("Anna"), F.concat(F.lit(" Anna  Lee"), "n"), F.concat_ws(" ", F.lit("Jan van"), "s"), F.lit(None), F.lit("")), (F.col("k") % 5 + 1).cast("int")).alias("displayName"), F.when(F.col("k") % 7 == 0, "Eva").alias("givenName"))).alias("names"),
    )
    return raw.select("k", "t", "s", "p", "u", F.from_json(F.to_json(contact), CONTACT).alias("c")).select("k", "t", "s", "p", "u", "c.*")


def _proposals(people: DataFrame, rule) -> DataFrame:
    return people.select(F.col("k").alias("c_custkey"), F.explode(rule).alias("x")).select("c_custkey", "x.field", "x.old", "x.new", "x.confidence", "x.reason")


_C = "c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS t, lower(c_mktsegment) AS s, c_nationkey AS n FROM customer)"


def phone_proposals(spark, sf):
    return _proposals(_people(spark, sf), rules.phone_rules())


PHONE_PROPOSALS = f"""WITH {_C}, p AS (SELECT k, 0 AS i, {_SPELLED} AS raw, CASE WHEN k % 5 = 0 THEN 'work' ELSE '' END AS kind FROM c UNION ALL SELECT k, 1, CASE WHEN k % 4 = 0 THEN {_SPELLED} ELSE concat('09', reverse(t)) END, 'mobile' FROM c),
d AS (SELECT *, trim(raw) AS r, regexp_replace(raw, '\\D', '', 'g') AS d FROM p),
f AS (SELECT *, r LIKE '+%' OR d LIKE '00%' AS abroad, CASE WHEN r LIKE '+%' THEN d WHEN d LIKE '00%' THEN d[3:] WHEN regexp_matches(d, '^0[1-9]\\d{{8}}$') THEN concat('421', d[2:]) WHEN regexp_matches(d, '^9\\d{{8}}$') THEN concat('421', d) ELSE d END AS w FROM d),
v AS (SELECT *, regexp_matches(w, '^42[01]\\d{{9}}$') AS home, regexp_matches(w, '^42[01]\\d{{9}}$') OR (abroad AND regexp_matches(w, '^[1-9]\\d{{7,14}}$') AND NOT regexp_matches(w, '^42[01]')) AS valid FROM f),
n AS (SELECT *, CASE WHEN NOT valid THEN r WHEN w LIKE '4212%' THEN concat('+421 2 ', w[5:7], ' ', w[8:10], ' ', w[11:12]) WHEN home THEN concat('+', w[1:3], ' ', w[4:6], ' ', w[7:9], ' ', w[10:12]) ELSE concat('+', w) END AS written,
 CASE WHEN NOT home THEN 'unknown' WHEN w LIKE '4219%' OR regexp_matches(w, '^420[67]') THEN 'mobile' ELSE 'fixed_line' END AS found FROM v),
o AS (SELECT *, regexp_replace(written, '\\D', '', 'g') AS key FROM n)
SELECT k AS c_custkey, concat('phoneNumbers[', i, '].value') AS field, raw AS old, written AS new, 0.95::DOUBLE AS confidence, 'phone number normalization to international format' AS reason FROM o WHERE valid AND written <> raw
UNION ALL SELECT k, concat('phoneNumbers[', i, '].type'), '', found, 0.8, concat('phone type detection (', found, ')') FROM o WHERE kind = '' AND found <> 'unknown'
UNION ALL SELECT k, 'phoneNumbers[1]', raw, '__DUPLICATE__', 0.9, 'duplicate phone number within contact' FROM o WHERE i = 1 AND EXISTS (SELECT 1 FROM o x WHERE x.k = o.k AND x.i = 0 AND x.key = o.key)"""


def page_proposals(spark, sf):
    return _proposals(_people(spark, sf), rules.url_rules())


PAGE_PROPOSALS = f"""WITH {_C}, u AS (SELECT k, s, trim({_PAGES}) AS u FROM c), h AS (SELECT *, regexp_replace(lower(regexp_extract(CASE WHEN contains(u, '://') THEN u ELSE concat('https://', u) END, '://([^/?#:]*)', 1)), '^www\\.', '') AS host,
 lower(regexp_replace(regexp_extract(CASE WHEN contains(u, '://') THEN u ELSE concat('https://', u) END, '://[^/?#]*([^?#]*)', 1), '/+$', '')) AS path FROM u),
m AS (SELECT *, regexp_extract(host, '([^.]+)\\.[^.]+$', 1) = s AS mine, regexp_extract(path, '^/([^/]+)', 1) = s AS theirs, host = 'linkedin.com' AS profile, host IN ('yelp.com', 'crunchbase.com') AS listed, host IN ('facebook.com', 'twitter.com') AS social FROM h),
r AS (SELECT *, CASE WHEN profile THEN CASE WHEN regexp_matches(path, '^/(company|school|showcase|organization)/') THEN 0.95 END WHEN listed THEN 0.90 WHEN social THEN CASE WHEN theirs THEN 0.80 END WHEN mine AND path = '' THEN 0.85 WHEN mine THEN 0.65 END AS confidence FROM m WHERE host <> '')
SELECT k AS c_custkey, 'urls[0]' AS field, u AS old, '' AS new, confidence::DOUBLE AS confidence, CASE WHEN profile THEN 'corporate LinkedIn page (not a personal profile)' WHEN listed THEN 'corporate directory listing' WHEN social THEN 'corporate social media page (matches organization name)'
 WHEN path = '' THEN 'corporate website homepage (matches organization)' ELSE 'corporate website link (matches organization)' END AS reason FROM r WHERE confidence IS NOT NULL"""


def name_fill_proposals(spark, sf):
    return _proposals(_people(spark, sf), rules.cross_field_rules())


NAME_FILL_PROPOSALS = f"""WITH {_C}, n AS (SELECT k, CASE k % 5 WHEN 0 THEN 'Anna' WHEN 1 THEN concat(' Anna  Lee', n) WHEN 2 THEN concat('Jan van ', s) ELSE '' END AS d FROM c WHERE k % 7 <> 0), w AS (SELECT k, string_split_regex(trim(d), '\\s+') AS w FROM n WHERE regexp_matches(trim(d), '^\\S+\\s+\\S'))
SELECT k AS c_custkey, 'names[0].givenName' AS field, '' AS old, w[1] AS new, 0.8::DOUBLE AS confidence, 'name extracted from display name' AS reason FROM w
UNION ALL SELECT k, 'names[0].familyName', '', array_to_string(w[2:], ' '), 0.8, 'name extracted from display name' FROM w"""


#: Notes with the digits e (eight, the first a 5), beside whatever follows the marker.
NOTES = ["concat('tel 0911 ', left(e, 3), ' ', substr(e, 4, 3))", "concat('write to X', k, '@Firm.SK, or x', k, '@firm.sk')", "concat('IČO: ', e)", "concat('DIČ ', '20', e)", "concat('IČ DPH sk20', e)", "concat('born ', 1 + k % 28, '.2.19', 50 + k % 50)", "concat('wedding 2001-0', 1 + k % 9, '-05, signed 2002-03-04')", "''", "concat('call +421 911 222 333, +421 903 ', left(e, 3), ' ', substr(e, 4, 3))", "concat('meniny 4/5/', 1990 + k % 30, ' or 13/13/2000')"]
_NOTES = "CASE k % 10 " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(NOTES)) + " END"


def note_proposals(spark, sf):
    """What the customers' notes hold; what follows an earlier block's marker is left out."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("5"), F.right(F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0"), F.lit(7))).alias("e"))
    note = F.concat(F.expr(_NOTES), F.when(F.col("k") % 3 == 0, "\n── Last Interaction (auto) ──\nborn 3.4.1999 z@z.zz").otherwise(""))
    contact = F.struct(F.array(F.struct(note.alias("value"))).alias("biographies"), F.array(F.struct(F.lit("+421 911 222 333").alias("value"))).alias("phoneNumbers"), F.when(F.col("k") % 20 == 5, F.array(F.struct(F.struct(F.lit(1990).alias("year")).alias("date")))).alias("birthdays"))
    people = c.select("k", F.from_json(F.to_json(contact), CONTACT).alias("c")).select("k", "c.*")
    return _proposals(people, F.concat(rules.note_rules(), rules.date_rules(2024)))


NOTE_PROPOSALS = """WITH c AS (SELECT c_custkey AS k, concat('5', right(lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0'), 7)) AS e FROM customer),
r AS (SELECT k, 'phoneNumbers[+]' AS field, concat('+421 911 ', e[1:3], ' ', e[4:6]) AS new, 0.7 AS confidence, 'phone number found in notes' AS reason FROM c WHERE k % 10 = 0
 UNION ALL SELECT k, 'phoneNumbers[+]', concat('+421 903 ', e[1:3], ' ', e[4:6]), 0.7, 'phone number found in notes' FROM c WHERE k % 10 = 8
 UNION ALL SELECT k, 'emailAddresses[+]', concat('x', k, '@firm.sk'), 0.7, 'email found in notes' FROM c WHERE k % 10 = 1
 UNION ALL SELECT k, 'userDefined[+]', e, 0.92, 'company ID found in notes' FROM c WHERE k % 10 = 2
 UNION ALL SELECT k, 'userDefined[+]', concat('20', e), 0.92, 'tax ID found in notes' FROM c WHERE k % 10 = 3
 UNION ALL SELECT k, 'userDefined[+]', concat('SK20', e), 0.92, 'VAT ID found in notes' FROM c WHERE k % 10 = 4
 UNION ALL SELECT k, 'birthdays[+]', concat('19', 50 + k % 50, '-02-', lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0')), 0.6, concat('birthday extracted from notes (', 1 + k % 28, '.2.19', 50 + k % 50, ')') FROM c WHERE k % 10 = 5 AND k % 20 <> 5
 UNION ALL SELECT k, 'events[+]', d, 0.55, concat('event extracted from notes (anniversary: ', d, ')') FROM (SELECT k, unnest([concat('2001-0', 1 + k % 9, '-05'), '2002-03-04']) AS d FROM c WHERE k % 10 = 6)
 UNION ALL SELECT k, 'events[+]', concat(1990 + k % 30, '-05-04'), 0.55, concat('event extracted from notes (nameday: 4/5/', 1990 + k % 30, ')') FROM c WHERE k % 10 = 9)
SELECT k AS c_custkey, field, '' AS old, new, confidence::DOUBLE AS confidence, reason FROM r"""


def message_records(spark, sf):
    """Conversations as messages of five networks -> interaction records, flat."""
    c = table(spark, sf, "conversations")
    network = F.element_at(F.array(*map(F.lit, ("WhatsApp", "facebookgo.x", "matrix-Signal", "linkedin", "newnet"))), (F.col("conv_id") % 5 + 1).cast("int"))
    person = lambda handle, own: F.struct(handle.alias("handle"), F.lit("n").alias("name"), F.lit(own).alias("self"))
    people = F.array(person(F.concat(F.lit("p"), "conv_id", F.lit("@x.example")), False), person(F.concat(F.lit("+421 90"), F.col("turn") % 10, F.lit(" 123 456")), False), person(F.concat(F.lit("@h"), "conv_id"), False), person(F.lit("me@own.example"), True))
    body = F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.col("text"))
    messages = c.select(network.alias("network"), F.concat(F.lit("chat"), "conv_id").alias("chat"), F.col("turn").cast("string").alias("id"), F.when(F.col("role") != "system", F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn"))).alias("ts"), body.alias("text"), (F.col("role") == "assistant").alias("is_sender"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("file"))).otherwise(F.array().cast("array<string>")).alias("attachments"), people.alias("participants"))
    m = ingest.to_records(messages)
    return m.select("interactionId", "channel", "direction", "threadId", F.unix_micros("timestamp").alias("at_us"), F.length("summary").cast("long").alias("size"), F.left("summary", F.lit(20)).alias("begins"), F.array_join("matchCandidates.emails", ",").alias("emails"), F.array_join("matchCandidates.phones", ",").alias("phones"), F.array_join("matchCandidates.handles", ",").alias("handles"))


MESSAGE_RECORDS = """WITH m AS (SELECT *, ['WhatsApp', 'facebookgo.x', 'matrix-Signal', 'linkedin', 'newnet'][1 + conv_id % 5] AS network, ['whatsapp', 'messenger', 'signal', 'linkedin_dm', 'newnet'][1 + conv_id % 5] AS channel, trim(CASE WHEN turn % 4 = 3 THEN '' ELSE text END) AS body FROM conversations WHERE role <> 'system'),
s AS (SELECT *, CASE WHEN body <> '' THEN body WHEN conv_id % 2 = 0 THEN '[attachment]' ELSE '[empty]' END AS said FROM m)
SELECT substr(sha256(concat_ws('|', network, concat('chat', conv_id), turn::VARCHAR)), 1, 16) AS "interactionId", channel, CASE WHEN role = 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction, concat(channel, ':chat', conv_id) AS "threadId", (conv_id * 1000 + turn) * 1000000 AS at_us,
 least(length(said), 500) AS size, CASE WHEN length(said) > 500 THEN concat(said[1:499], '…') ELSE said END[1:20] AS begins, concat('p', conv_id, '@x.example') AS emails, concat('+421 90', turn % 10, ' 123 456') AS phones, concat('@h', conv_id) AS handles FROM s"""


def note_blocks(spark, sf):
    """Notes that get a block, then another day's block in its place, then lose it."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("met at "), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "\nand again").otherwise(""))).alias("note"), F.concat(F.lit("Stage: "), "c_nationkey").alias("body"))
    one = c.withColumn("one", N.merged("note", N.block("State", "2024-01-30", F.col("body")), "State"))
    two = one.withColumn("two", N.merged("one", N.block("State", "2024-01-31", F.lower("body")), "State"))
    same = N.needs_update("two", N.block("State", "2024-01-31", F.lower("body")), "State")
    return two.select("c_custkey", "one", "two", N.stripped("two", "State").alias("stripped"), same.alias("again"))


_BLOCK = "concat('── State (auto · 2024-01-{d}) ──', chr(10), {b}, chr(10), '── End State ──')"
NOTE_BLOCKS = f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN concat('met at ', lower(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN concat(chr(10), 'and again') ELSE '' END) END AS note, {_BLOCK.format(d=30, b="concat('Stage: ', c_nationkey)")} AS a, {_BLOCK.format(d=31, b="concat('stage: ', c_nationkey)")} AS b FROM customer)
SELECT c_custkey, concat_ws(chr(10) || chr(10), a, note) AS one, concat_ws(chr(10) || chr(10), b, note) AS two, CASE WHEN note IS NULL THEN '' ELSE concat(chr(10), note) END AS stripped, false AS again FROM c"""


def profile_texts(spark, sf):
    """Profile pages made of orders: headline, job change, posts, and their kind."""
    o = table(spark, sf, "orders").where("o_orderkey % 5 < 4").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("kind"), F.lower("o_orderpriority").alias("p"), F.concat(F.lit("Org "), F.col("o_custkey")).alias("org"))
    lines = F.array_join(F.array(F.lit("About"), F.when(F.col("kind") != 3, F.concat(F.lit(" Manager of "), "p")), F.when(F.col("kind") == 0, F.concat(F.lit("Has joined "), "org", F.lit(" lately"))), F.when(F.col("kind") == 1, F.concat(F.lit("Recent activity\nshort\nA post that is long enough to count, of "), "p"))), "\n")
    seen = O.profile_signals(lines)
    company = F.when(F.col("kind") == 0, F.concat(F.col("org"), F.lit("x"))).when(F.col("kind") == 2, F.upper("org"))
    rows = o.select("id", seen.alias("x"), F.col("org"), company.alias("company"))
    kind = O.classify_profile(F.col("org"), F.concat(F.lit("New "), F.reverse("company")), F.array_join("x.recent_posts", ";"), F.col("x.headline"))
    return rows.select("id", "x.headline", "x.job_change", F.array_join("x.recent_posts", ";").alias("posts"), kind.signal_type.alias("signal_type"), kind.signal_text.alias("signal_text"))


PROFILE_TEXTS = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS kind, lower(o_orderpriority) AS p, concat('Org ', o_custkey) AS org FROM orders WHERE o_orderkey % 5 < 4),
x AS (SELECT *, CASE WHEN kind <> 3 THEN concat('Manager of ', p) ELSE '' END AS headline, CASE WHEN kind = 0 THEN concat('Has joined ', org, ' lately') ELSE '' END AS job_change, CASE WHEN kind = 1 THEN concat('A post that is long enough to count, of ', p) ELSE '' END AS posts,
 CASE kind WHEN 0 THEN concat('New ', reverse(concat(org, 'x'))) WHEN 2 THEN concat('New ', reverse(upper(org))) END AS company FROM o)
SELECT id, headline, job_change, posts, CASE WHEN company IS NOT NULL THEN 'job_change' WHEN posts <> '' THEN 'active' WHEN headline <> '' THEN 'profile' ELSE 'no_activity' END AS signal_type,
 CASE WHEN company IS NOT NULL THEN concat(org, ' → ', company) WHEN posts <> '' THEN posts WHEN headline <> '' THEN headline ELSE 'No recent public activity' END AS signal_text FROM x"""


def near_name_pairs(spark, sf):
    """Customers' spelled names with the same first three letters, 80 percent alike."""
    c = table(spark, sf, "customer").select(F.concat_ws(" ", F.translate((F.col("c_custkey") * 7919 % 99991).cast("string"), "0123456789", "aeioubdgkm"), F.lower(F.left("c_mktsegment", F.lit(5)))).alias("name"))
    return R.fuzzy_pairs(c, "name", "name").withColumn("score", F.round("score", 2))


NEAR_NAME_PAIRS = """WITH RECURSIVE n AS (SELECT DISTINCT concat(translate(CAST(c_custkey * 7919 % 99991 AS VARCHAR), '0123456789', 'aeioubdgkm'), ' ', lower(left(c_mktsegment, 5))) AS s FROM customer), p AS (SELECT a.s AS x, b.s AS y FROM n a JOIN n b ON a.s[1:3] = b.s[1:3] AND a.s < b.s),
t(x, y, i, r) AS (SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM t WHERE i < length(x))
SELECT x AS name_a, y AS name_b, round(200.0 * r[-1] / (length(x) + length(y)), 2)::DOUBLE AS score FROM t WHERE i = length(x) AND 200.0 * r[-1] / (length(x) + length(y)) >= 80"""

QUERIES = {
    "note_proposals": (note_proposals, NOTE_PROPOSALS),
    "message_records": (message_records, MESSAGE_RECORDS),
    "phone_proposals": (phone_proposals, PHONE_PROPOSALS),
    "page_proposals": (page_proposals, PAGE_PROPOSALS),
    "name_fill_proposals": (name_fill_proposals, NAME_FILL_PROPOSALS),
    "note_blocks": (note_blocks, NOTE_BLOCKS),
    "profile_texts": (profile_texts, PROFILE_TEXTS),
    "near_name_pairs": (near_name_pairs, NEAR_NAME_PAIRS),
}
