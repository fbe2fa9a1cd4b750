"""Rules, predicates and logs of contacts that are made from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import apply as P
from ..operators import audit as U
from ..operators import feedback as B
from ..operators import outreach as O
from ..operators import resolve as R
from ..operators import rules
from ..operators import scoring as S
from ..operators import status
from ..schemas import CONTACT
from ..session import table
from ..streaming import ingest

OWNER, PRIVATE = "own@acme.example", "gmail.com"


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as contacts whose parts come and go with the key."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    some = lambda n, value: F.when(F.col("c_custkey") % n == 0, value)
    mails = F.array_compact(F.array(F.concat(F.lit(" C"), k, F.lit("@Acme.Example")), some(2, F.concat(F.lit("c"), k, F.lit("@acme.example"))), some(5, F.lit("bad@@x")), some(7, F.lit(OWNER))))
    code = (10000 + F.col("c_custkey") * 37 % 89999).cast("string")
    parts = F.struct(
        F.concat(F.lit("people/c"), k).alias("resourceName"),
        F.transform(mails, lambda m: F.struct(m.alias("value"))).alias("emailAddresses"),
        F.array(F.struct(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Block "), F.col("c_custkey") % 60)).alias("streetAddress"), F.when(F.col("c_custkey") % 3 != 0, F.lit("Nitra")).alias("city"), code.alias("postalCode"))).alias("addresses"),
        F.array(F.struct(F.concat("c_mktsegment", F.lit(" SRO")).alias("name"), F.lit("sales manager").alias("title"))).alias("organizations"),
    )
    return c.select("c_custkey", F.from_json(F.to_json(parts), CONTACT).alias("c")).select("c_custkey", "c.*")


def _proposals(spark, sf, rule):
    return contacts(spark, sf).select("c_custkey", F.explode(rule).alias("x")).select("c_custkey", "x.field", "x.old", "x.new", "x.confidence", "x.reason")


def mail_rules(spark, sf):
    return _proposals(spark, sf, rules.email_rules([OWNER]))


MAIL_RULES = """WITH c AS (SELECT c_custkey AS k, 1 + (c_custkey % 2 = 0)::INT AS bad, 1 + (c_custkey % 2 = 0)::INT + (c_custkey % 5 = 0)::INT AS own FROM customer)
SELECT k AS c_custkey, 'emailAddresses[0].value' AS field, concat(' C', k, '@Acme.Example') AS old, concat('c', k, '@acme.example') AS new, 0.95::DOUBLE AS confidence, 'email normalization (lowercase, trim)' AS reason FROM c
UNION ALL SELECT k, 'emailAddresses[1]', concat('c', k, '@acme.example'), '__DUPLICATE__', 0.9, 'duplicate email within contact' FROM c WHERE k % 2 = 0
UNION ALL SELECT k, concat('emailAddresses[', bad, ']'), 'bad@@x', '__INVALID__', 0.7, 'invalid email format' FROM c WHERE k % 5 = 0
UNION ALL SELECT k, concat('emailAddresses[', own, ']'), 'own@acme.example', '', 0.95, 'owner email (own@acme.example) incorrectly on non-owner contact' FROM c WHERE k % 7 = 0"""


def place_rules(spark, sf):
    return _proposals(spark, sf, rules.address_rules())


PLACE_RULES = """WITH c AS (SELECT c_custkey, CAST(10000 + c_custkey * 37 % 89999 AS VARCHAR) AS code, c_custkey % 3 <> 0 AS placed FROM customer), d AS (SELECT *, CASE WHEN code[1] IN ('0', '8', '9') THEN 'SK' ELSE 'CZ' END AS cc FROM c)
SELECT c_custkey, 'addresses[0].postalCode' AS field, code AS old, concat(code[1:3], ' ', code[4:5]) AS new, 0.95::DOUBLE AS confidence, 'postal code formatting (XXX XX)' AS reason FROM d
UNION ALL SELECT c_custkey, 'addresses[0].country', '', CASE cc WHEN 'SK' THEN 'Slovensko' ELSE 'Česko' END, 0.75, concat('country inferred from postal code (', cc, ')') FROM d WHERE placed
UNION ALL SELECT c_custkey, 'addresses[0].countryCode', '', cc, 0.75, 'country code inferred from postal code' FROM d WHERE placed"""


def company_rules(spark, sf):
    return _proposals(spark, sf, rules.organization_rules())


COMPANY_RULES = """SELECT c_custkey, 'organizations[0].name' AS field, concat(c_mktsegment, ' SRO') AS old, concat(c_mktsegment[1], lower(c_mktsegment[2:]), ' s.r.o.') AS new, 0.7::DOUBLE AS confidence, 'fix letter casing (organization)' AS reason FROM customer
UNION ALL SELECT c_custkey, 'organizations[0].title', 'sales manager', 'Sales Manager', 0.7, 'fix letter casing (job title)' FROM customer"""


def shared_places(spark, sf):
    made = rules.shared_address_rule(contacts(spark, sf).withColumn("addresses", F.transform("addresses", lambda a: a.withField("postalCode", F.lit(None).cast("string")))))
    return made.select("resourceName", "change.field", "change.old", "change.confidence", "change.reason")


SHARED_PLACES = """WITH c AS (SELECT concat('people/c', c_custkey) AS "resourceName", concat('block ', c_custkey % 60, '|nitra') AS key FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT key, count(*) AS n FROM c GROUP BY key HAVING n >= 3)
SELECT "resourceName", 'addresses[0]' AS field, key AS old, CASE WHEN n >= 10 THEN 0.9 WHEN n >= 5 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence, concat('shared office address (', n, ' contacts)') AS reason FROM c JOIN n USING (key)"""


def mail_inference(spark, sf):
    rows = contacts(spark, sf).withColumn("emailAddresses", F.array(F.struct(F.concat(F.lit("ann.lee"), F.col("c_custkey") % 9, F.lit("@"), F.when(F.col("c_custkey") % 4 == 0, PRIVATE).otherwise("widgets.example")).alias("value"), F.lit(None).cast("string").alias("type"))))
    rows = rows.withColumn("organizations", F.when(F.col("c_custkey") % 5 != 0, F.col("organizations")))
    return rows.select("c_custkey", F.explode(rules.mail_rules()).alias("x")).select("c_custkey", "x.field", "x.new", "x.confidence")


MAIL_INFERENCE = """SELECT c_custkey, f.field, f.new, f.confidence::DOUBLE AS confidence FROM customer, (VALUES ('names[0].givenName', 'Ann', 0.55), ('names[0].familyName', 'Lee', 0.55), ('organizations[+].name', 'Widgets', 0.5)) f(field, new, confidence)
WHERE f.confidence > 0.5 OR (c_custkey % 5 = 0 AND c_custkey % 4 <> 0)"""


def deletion_candidates(spark, sf):
    """Contacts stripped of what their key takes away."""
    rows = contacts(spark, sf)
    drop = lambda name, n: F.when(F.col("c_custkey") % n != 0, F.col(name))
    rows = rows.withColumn("organizations", F.transform("organizations", lambda o: o.withField("title", F.lit(None).cast("string")))).withColumn("emailAddresses", drop("emailAddresses", 2)).withColumn("addresses", drop("addresses", 3))
    return rows.select("c_custkey", F.explode(rules.deletion_rule()).alias("x")).select("c_custkey", "x.new", "x.confidence", "x.reason")


DELETION_CANDIDATES = """SELECT c_custkey, '__TO_BE_DELETED__' AS new, CASE WHEN (c_custkey % 2 <> 0)::INT * 0.5 + (c_custkey % 3 <> 0)::INT <= 0.5 THEN 0.55 ELSE 0.45 END::DOUBLE AS confidence,
concat('low-value contact deletion candidate (', concat_ws(', ', 'no full name', CASE WHEN c_custkey % 2 = 0 THEN 'no email' END, 'no phone', CASE WHEN c_custkey % 3 = 0 THEN 'no address' END), ')') AS reason
FROM customer WHERE (c_custkey % 2 <> 0)::INT * 0.5 + (c_custkey % 3 <> 0)::INT <= 1"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as proposals: of a supplier's contact, with a confidence and a kind of reason."""
    x = table(spark, sf, "lineitem")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("phoneNumbers", "emailAddresses", "names", "relations"))), (F.col("l_linenumber") % 4 + 1).cast("int")), F.lit("[0].value"))
    return x.select(F.col("l_suppkey").alias("resource_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), path.alias("field"), F.col("l_returnflag").alias("old"), F.col("l_linestatus").alias("new"), (F.col("l_discount") * 10).alias("confidence"), F.lit("").alias("reason"))


_CHANGES = "x AS (SELECT l_suppkey AS resource_name, l_orderkey * 10 + l_linenumber AS seq, concat(['phoneNumbers', 'emailAddresses', 'names', 'relations'][l_linenumber % 4 + 1], '[0].value') AS field, l_returnflag AS old, l_linestatus AS new, l_discount * 10 AS confidence FROM lineitem)"


def field_categories(spark, sf):
    return changes(spark, sf).groupBy(U.field_category(F.col("field")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


FIELD_CATEGORIES = f"WITH {_CHANGES} SELECT CASE WHEN field LIKE 'relations%' THEN 'other' ELSE string_split(field, '[')[1] END AS category, count(*) AS n FROM x GROUP BY 1"


def review_split(spark, sf):
    """What is applied, what is reviewed, and of it the medium band, per contact."""
    c = changes(spark, sf)
    sure, rest = P.split_auto(c, 0.90)
    per = c.groupBy("resource_name").agg(F.collect_list(F.struct("confidence")).alias("all"))
    n = lambda df, name: df.groupBy("resource_name").agg(F.count(F.lit(1)).alias(name))
    out = per.select("resource_name", P.needs_review(F.col("all")).alias("needs_review"))
    for df, name in ((sure, "applied"), (rest, "reviewed"), (P.medium(c), "medium")):
        out = out.join(n(df, name), "resource_name", "left")
    return out.fillna(0)


REVIEW_SPLIT = f"WITH {_CHANGES} SELECT resource_name, bool_or(confidence < 0.9) AS needs_review, count(*) FILTER (confidence >= 0.9) AS applied, count(*) FILTER (confidence < 0.9) AS reviewed, count(*) FILTER (confidence >= 0.6 AND confidence < 0.9) AS medium FROM x GROUP BY 1"


def review_changes(spark, sf):
    r = P.review_file(changes(spark, sf))
    return r.select("resource_name", F.size("changes").cast("long").alias("n"), F.col("changes")[0].seq.alias("first"), F.element_at("changes", -1).seq.alias("last"))


REVIEW_CHANGES = f"WITH {_CHANGES} SELECT resource_name, count(*) AS n, min(seq) AS first, max(seq) AS last FROM x WHERE old <> new GROUP BY 1"


def handle_kinds(spark, sf):
    c = table(spark, sf, "customer")
    handle = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), "c_custkey", F.lit("@x.example"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+421 903 "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", ingest.handle_kind(handle).alias("kind"))


HANDLE_KINDS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'handle' END AS kind FROM customer"


def apple_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", T.to_apple_time(F.col("ts")).alias("ns"))
    return e.select("event_id", "ns", F.unix_micros(T.apple_time(F.col("ns"))).alias("micros"))


APPLE_TIMES = "SELECT event_id, (epoch_us(ts) - 978307200000000) * 1000 AS ns, epoch_us(ts) AS micros FROM events"


def address_keys(spark, sf):
    a = contacts(spark, sf).select("c_custkey", F.col("addresses")[0].alias("a"))
    return a.select("c_custkey", T.address_key(F.col("a.streetAddress"), F.col("a.city"), F.col("a.postalCode"), F.lit(None).cast("string")).alias("key"))


ADDRESS_KEYS = "SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 3 <> 0 THEN concat('block ', c_custkey % 60, '|nitra') END, 10000 + c_custkey * 37 % 89999) AS key FROM customer"


def legal_ids(spark, sf):
    note = F.concat(F.lit("IČO: "), F.lpad(F.col("c_custkey").cast("string"), 8, "1"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(", DIČ "), F.lpad(F.col("c_custkey").cast("string"), 10, "2"))).otherwise(""), F.lit(" sk"), F.lpad(F.col("c_custkey").cast("string"), 10, "3"))
    return table(spark, sf, "customer").select("c_custkey", T.legal_ids(note).alias("x")).select("c_custkey", "x.*")


LEGAL_IDS = "SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '1') AS company_id, CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 10, '2') END AS tax_id, concat('SK', lpad(c_custkey::VARCHAR, 10, '3')) AS vat_id FROM customer"


def profile_urls(spark, sf):
    c = table(spark, sf, "customer")
    url = F.concat(F.when(F.col("c_custkey") % 2 == 0, "http://sk.LinkedIn.com/in/").otherwise("https://x.example/in/"), "c_mktsegment", F.lit("-"), "c_custkey", F.lit("/?trk=1"))
    return c.select("c_custkey", T.profile_url(url).alias("profile"))


PROFILE_URLS = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('https://www.linkedin.com/in/', lower(c_mktsegment), '-', c_custkey) END AS profile FROM customer"


def contact_flags(spark, sf):
    """Generic, private and own addresses, short headlines, dates to scan again."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    mail = F.concat(F.when(k % 6 == 0, "Info").otherwise(F.concat(F.lit("p"), k.cast("string"))), F.lit("@"), F.when(k % 4 == 0, PRIVATE).otherwise("acme.example"))
    return c.select(
        "c_custkey",
        rules.is_generic(mail).alias("generic"),
        S.likely_personal(k % 5 == 0, k % 7 == 0, F.lit(""), F.array(mail)).alias("personal"),
        S.own_company(F.col("c_mktsegment"), F.array(mail), ["machin"], ["nowhere.example"]).alias("own"),
        S.signal_type(F.lit("job_change"), F.repeat(F.lit("x"), (k % 30).cast("int"))).alias("signal"),
        S.completeness(k % 2 == 0, k % 3 == 0, k % 5 == 0).cast("long").alias("completeness"),
        A.mass_event(F.sequence(F.lit(0), (k % 20).cast("int")), F.col("c_mktsegment")).alias("mass"),
    )


CONTACT_FLAGS = """SELECT c_custkey, c_custkey % 6 = 0 AS generic, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 4 = 0 AS personal, c_mktsegment LIKE 'MACHIN%' AS own,
CASE WHEN c_custkey % 30 < 15 THEN 'profile' ELSE 'job_change' END AS signal, (c_custkey % 2 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT + (c_custkey % 5 = 0)::BIGINT AS completeness, c_custkey % 20 >= 10 AS mass FROM customer"""


def checked_updates(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = c.select("c_custkey", F.concat(F.when(k % 4 == 0, "person/").otherwise("people/c"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "nowhere").when(k % 3 == 1, "won").alias("stage"), F.repeat(F.lit("x"), (k % 9).cast("int")).alias("notes"), ((k % 10) / 10).alias("medium"), F.lit(0.5).alias("high"))
    return O.checked_update(rows, S.STAGES, 6).select("c_custkey", F.array_join("errors", ",").alias("errors"))


CHECKED_UPDATES = "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'id' END, CASE WHEN c_custkey % 3 = 0 THEN 'stage' END, CASE WHEN c_custkey % 9 > 6 THEN 'notes' END, CASE WHEN c_custkey % 10 >= 5 THEN 'thresholds' END) AS errors FROM customer"


def names_of_ids(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    plan = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    signals = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return O.display_names(ids, plan, signals)


NAMES_OF_IDS = "SELECT c_custkey::VARCHAR AS id, coalesce(s_name, p_name, c_custkey::VARCHAR) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey"


def harvest_counts(spark, sf):
    """Per channel and month what was seen, new, matched and not."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("contactId"), "event_id")
    return status.harvest_summary(e, e.where("event_id % 2 = 0"))


HARVEST_COUNTS = """SELECT event_type AS channel, strftime(ts, '%Y-%m') AS month, count(*) AS seen, count(*) FILTER (event_id % 2 = 0) AS new, count(*) FILTER (event_id % 2 = 0 AND user_id % 3 <> 0) AS matched, count(*) FILTER (event_id % 2 = 0 AND user_id % 3 = 0) AS unmatched FROM events GROUP BY ALL"""


def session_results(spark, sf):
    o = table(spark, sf, "orders")
    log = o.select(F.lit("batch_end").alias("type"), F.col("o_orderpriority").alias("session_id"), F.col("o_orderkey").alias("success"), F.col("o_custkey").alias("failed"))
    return status.run_status(log, "1-URGENT", "2024-01-01 00:00:00", "2024-01-01 00:02:22")


SESSION_RESULTS = "SELECT CAST(sum(o_orderkey) AS BIGINT) AS applied, CAST(sum(o_custkey) AS BIGINT) AS failed, 142::BIGINT AS seconds FROM orders WHERE o_orderpriority = '1-URGENT'"


def token_costs(spark, sf):
    calls = table(spark, sf, "orders").select(F.col("o_custkey").alias("tokens_in"), F.col("o_orderkey").alias("tokens_out"))
    return status.token_cost(calls, 3.0, 15.0).withColumn("cost", F.round("cost", 4))


TOKEN_COSTS = "SELECT count(*) AS calls, round((sum(o_custkey) * 3.0 + sum(o_orderkey) * 15.0) / 1e6, 4)::DOUBLE AS cost, (sum(o_custkey) * 3.0 + sum(o_orderkey) * 15.0) / 1e6 >= 1 AS exceeded FROM orders"


def match_bands(spark, sf):
    return R.match_report(table(spark, sf, "lineitem").select((F.col("l_quantity") + 50).alias("score")))


MATCH_BANDS = "SELECT count(*) AS matches, count(*) FILTER (l_quantity >= 45) AS sure, count(*) FILTER (l_quantity >= 35 AND l_quantity < 45) AS likely, count(*) FILTER (l_quantity < 35) AS weak FROM lineitem"


def spelling_votes(spark, sf):
    o = table(spark, sf, "orders")
    votes = o.select(F.concat(F.lit("n"), (F.col("o_custkey") % 50).cast("string")).alias("original"), F.concat(F.lit("ň"), (F.col("o_custkey") % 50).cast("string")).alias("corrected"), (F.col("o_orderkey") % 7 < 4).alias("approved"))
    return B.diacritics_preference(votes)


SPELLING_VOTES = "SELECT concat('n', o_custkey % 50) AS name, CASE WHEN count(*) FILTER (o_orderkey % 7 < 4) > count(*) FILTER (o_orderkey % 7 >= 4) THEN concat('ň', o_custkey % 50) ELSE concat('n', o_custkey % 50) END AS preferred FROM orders GROUP BY o_custkey % 50"


def mail_matches(spark, sf):
    """An external list against contacts with string keys: the last contact that has an address."""
    c = table(spark, sf, "customer")
    contacts_ = c.select(F.concat(F.lit("people/c"), "c_custkey").alias("key"), F.col("c_custkey").alias("seq"), F.array(F.concat(F.lit("q"), F.col("c_custkey"))).alias("names"), F.array(F.concat(F.lit(" M"), F.col("c_custkey") % 700, F.lit("@X.example"))).alias("emails"), F.lit("").alias("org"))
    listed = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"), F.lit("").alias("name"), F.concat(F.lit("m"), F.col("s_suppkey"), F.lit("@x.example")).alias("email"), F.lit("").alias("org"))
    return R.match_connections(listed, contacts_)


MAIL_MATCHES = """WITH o AS (SELECT c_custkey % 700 AS m, max(c_custkey) AS k FROM customer GROUP BY 1)
SELECT concat('s', lpad(s_suppkey::VARCHAR, 6, '0')) AS id, concat('people/c', k) AS key, 98.0::DOUBLE AS score, 'email' AS route FROM supplier JOIN o ON m = s_suppkey"""


def message_log(spark, sf):
    r = O.message_stats(O.log_message(table(spark, sf, "orders").limit(0).select(F.col("o_custkey").alias("contact"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("text"), F.to_date("o_orderdate").alias("follow_up")), table(spark, sf, "orders").select(F.col("o_custkey").alias("contact"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("text"))).select(F.when(F.col("text") == "F", "DM_SENT").when(F.col("text") == "O", "RESPONDED").otherwise("DM_SKIPPED").alias("status"), "follow_up"), "1996-01-01")
    return r.withColumn("answered_percent", F.col("answered_percent").cast("long"))


MESSAGE_LOG = "SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) AS sent, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped, CAST(round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus IN ('F', 'O'))) AS BIGINT) AS answered_percent, count(*) FILTER (o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) + 7 <= DATE '1996-01-01') AS due FROM orders"

def applied_changes(spark, sf):
    """Proposals of seven kinds made to the customers' contacts, in order."""
    people, k = contacts(spark, sf), F.col("c_custkey")
    one = lambda seq, every, field, new, **extra: F.when(k % every == 0, F.struct(F.lit(seq).alias("seq"), F.lit(field).alias("field"), F.concat(*(k.cast("string") if x is None else F.lit(x) for x in new)).alias("new"), (F.create_map(*(F.lit(x) for kv in extra.items() for x in kv)) if extra else F.lit(None)).cast("map<string,string>").alias("extra")))
    made = F.array_compact(
        F.array(
            one(1, 2, "emailAddresses[0].value", ["m", None, "@new.example"]),
            one(2, 3, "email[0]", [""]),
            one(3, 4, "url[+]", ["https://x.example/", None], type="profile"),
            one(4, 5, "addresses[0].city", ["Zilina ", None]),
            one(5, 6, "birthdays[+]", ["in May"], date="1980-05-06"),
            one(6, 1, "organizations[7].name", ["none"]),
            one(7, 7, "name[+].familyName", ["N", None]),
        )
    )
    changes = people.select(F.col("resourceName").alias("resource_name"), F.explode(made).alias("x")).select("resource_name", "x.*")
    after = P.apply_changes(people, changes)
    text = lambda c, f: F.array_join(F.transform(c, f), ",", "-")
    return after.select("c_custkey", text("emailAddresses", lambda e: e.value).alias("emails"), text("urls", lambda e: F.concat_ws("|", e.type, e.value)).alias("urls"), text("addresses", lambda e: F.concat_ws("|", e.city, e.postalCode)).alias("places"), text("birthdays", lambda e: F.concat_ws("-", e.date.year, e.date.month, e.date.day)).alias("birthdays"), text("organizations", lambda e: e["name"]).alias("orgs"), text("names", lambda e: e.familyName).alias("names"))


APPLIED_CHANGES = """WITH c AS (SELECT c_custkey AS k, c_mktsegment, list_filter([CASE WHEN c_custkey % 2 = 0 THEN concat('m', c_custkey, '@new.example') ELSE concat(' C', c_custkey, '@Acme.Example') END, CASE WHEN c_custkey % 2 = 0 THEN concat('c', c_custkey, '@acme.example') END,
 CASE WHEN c_custkey % 5 = 0 THEN 'bad@@x' END, CASE WHEN c_custkey % 7 = 0 THEN 'own@acme.example' END], lambda x: x IS NOT NULL) AS mails FROM customer)
SELECT k AS c_custkey, array_to_string(CASE WHEN k % 3 = 0 THEN mails[2:] ELSE mails END, ',') AS emails, CASE WHEN k % 4 = 0 THEN concat('profile|https://x.example/', k) END AS urls,
 concat_ws('|', CASE WHEN k % 5 = 0 THEN concat('Zilina ', k) WHEN k % 3 <> 0 THEN 'Nitra' END, CAST(10000 + k * 37 % 89999 AS VARCHAR)) AS places, CASE WHEN k % 6 = 0 THEN '1980-5-6' END AS birthdays, concat(c_mktsegment, ' SRO') AS orgs, CASE WHEN k % 7 = 0 THEN concat('N', k) END AS names FROM c"""


QUERIES = {
    "applied_changes": (applied_changes, APPLIED_CHANGES),
    "mail_rules": (mail_rules, MAIL_RULES),
    "place_rules": (place_rules, PLACE_RULES),
    "company_rules": (company_rules, COMPANY_RULES),
    "shared_places": (shared_places, SHARED_PLACES),
    "mail_inference": (mail_inference, MAIL_INFERENCE),
    "deletion_candidates": (deletion_candidates, DELETION_CANDIDATES),
    "field_categories": (field_categories, FIELD_CATEGORIES),
    "review_split": (review_split, REVIEW_SPLIT),
    "review_changes": (review_changes, REVIEW_CHANGES),
    "handle_kinds": (handle_kinds, HANDLE_KINDS),
    "apple_times": (apple_times, APPLE_TIMES),
    "address_keys": (address_keys, ADDRESS_KEYS),
    "legal_ids": (legal_ids, LEGAL_IDS),
    "profile_urls": (profile_urls, PROFILE_URLS),
    "contact_flags": (contact_flags, CONTACT_FLAGS),
    "checked_updates": (checked_updates, CHECKED_UPDATES),
    "names_of_ids": (names_of_ids, NAMES_OF_IDS),
    "harvest_counts": (harvest_counts, HARVEST_COUNTS),
    "session_results": (session_results, SESSION_RESULTS),
    "token_costs": (token_costs, TOKEN_COSTS),
    "match_bands": (match_bands, MATCH_BANDS),
    "spelling_votes": (spelling_votes, SPELLING_VOTES),
    "mail_matches": (mail_matches, MAIL_MATCHES),
    "message_log": (message_log, MESSAGE_LOG),
}
