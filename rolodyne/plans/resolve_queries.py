"""Entity resolution and membership queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import ratio, token_sort_ratio
from ..operators import labels as L
from ..operators import resolve as R
from ..session import table


def exact_dupes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return R.groups(d, "doc_id", "text").select("id", "lead", "members")


EXACT_DUPES = "SELECT DISTINCT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS lead, count(*) OVER (PARTITION BY text) AS members FROM documents WHERE text IS NOT NULL QUALIFY members > 1"


def exact_pairs(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("/", "s_nationkey", F.floor(F.col("s_acctbal") / 500)).alias("key"))
    return R.equal_pairs(p, "s_suppkey", "key")


EXACT_PAIRS = "WITH p AS (SELECT s_suppkey AS a, concat_ws('/', s_nationkey, CAST(floor(s_acctbal / 500) AS BIGINT)) AS key FROM supplier) SELECT x.a, y.a AS b, x.key FROM p x JOIN p y ON x.key = y.key AND x.a < y.a"


def fuzzy_dupes(spark, sf):
    return R.fuzzy_pairs(table(spark, sf, "part"), "p_partkey", "p_name", 60.0, 2).withColumn("score", F.round("score", 2))


#: Recursive table over (i, j): the length of the common subsequence of every pair of prefixes.
_RATIO = """WITH RECURSIVE n AS (SELECT DISTINCT lower(p_name) AS s FROM part), p AS (SELECT a.s AS x, b.s AS y FROM n a JOIN n b ON a.s[1:{k}] = b.s[1:{k}] AND a.s < b.s),
t(x, y, i, r) AS (SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM t WHERE i < length(x))"""
FUZZY_DUPES = _RATIO.format(k=2) + """ SELECT x AS name_a, y AS name_b, round(200.0 * r[-1] / (length(x) + length(y)), 2)::DOUBLE AS score FROM t WHERE i = length(x) AND 200.0 * r[-1] / (length(x) + length(y)) >= 60"""


def similarity_table(spark, sf):
    """Native ratios of all distinct names against three given ones."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    given = spark.createDataFrame([("red ring",), ("widget small",), ("blue gear box",)], "target string")
    both = names.join(F.broadcast(given), F.lit(True))
    return both.select("name", "target", F.round(ratio(F.col("name"), F.col("target")), 2).alias("score"), F.round(token_sort_ratio(F.col("name"), F.col("target")), 2).alias("sorted_score"))


SIMILARITY_TABLE = """WITH RECURSIVE n AS (SELECT DISTINCT lower(p_name) AS name FROM part), g AS (SELECT * FROM (VALUES ('red ring'), ('widget small'), ('blue gear box')) v(target)),
p AS (SELECT name, target, name AS x, target AS y, 0 AS k FROM n, g UNION ALL SELECT name, target, array_to_string(list_sort(string_split(name, ' ')), ' '), array_to_string(list_sort(string_split(target, ' ')), ' '), 1 FROM n, g),
t(name, target, k, x, y, i, r) AS (SELECT name, target, k, x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT name, target, k, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM t WHERE i < length(x)),
s AS (SELECT name, target, k, round(200.0 * r[-1] / (length(x) + length(y)), 2)::DOUBLE AS v FROM t WHERE i = length(x))
SELECT name, target, max(v) FILTER (k = 0) AS score, max(v) FILTER (k = 1) AS sorted_score FROM s GROUP BY ALL"""


def best_match(spark, sf):
    left = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("org"))
    right = spark.createDataFrame([(1, "ring red"), (2, "small widget"), (3, "gear blue")], "key long, name string").withColumn("org", F.lit(""))
    return R.best_matches(left, right, 75.0)


BEST_MATCH = """WITH RECURSIVE n AS (SELECT DISTINCT lower(p_name) AS name FROM part), g AS (SELECT * FROM (VALUES (1::BIGINT, 'ring red'), (2, 'small widget'), (3, 'gear blue')) v(key, target)),
p AS (SELECT name, key, name AS x, target AS y FROM n, g UNION ALL SELECT name, key, array_to_string(list_sort(string_split(name, ' ')), ' '), array_to_string(list_sort(string_split(target, ' ')), ' ') FROM n, g),
t(name, key, x, y, i, r) AS (SELECT name, key, x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT name, key, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM t WHERE i < length(x)),
s AS (SELECT name, key, max(200.0 * r[-1] / (length(x) + length(y)))::DOUBLE AS v FROM t WHERE i = length(x) GROUP BY ALL HAVING v >= 75)
SELECT p_partkey AS id, key, round(v, 2) AS score FROM part JOIN s ON lower(p_name) = name QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, key) = 1"""


def multikey_match(spark, sf):
    c = table(spark, sf, "customer")
    cand = c.select(F.col("c_custkey").alias("record"), F.explode(F.array(F.struct(F.lit(1).alias("rule"), F.lit(0).alias("pos"), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 100)).alias("key")), F.struct(F.lit(2).alias("rule"), F.lit(0).alias("pos"), F.concat(F.lit("n"), "c_nationkey").alias("key")))).alias("x")).select("record", "x.*")
    s = table(spark, sf, "supplier")
    index = s.select(F.lit(1).alias("rule"), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 100)).alias("key"), F.col("s_suppkey").alias("contact"), F.col("s_suppkey").alias("seq")).union(s.where("s_nationkey < 12").select(F.lit(2), F.concat(F.lit("n"), "s_nationkey"), "s_suppkey", "s_suppkey"))
    return R.ranked_lookup(cand, index).withColumn("rule", F.col("rule").cast("long"))


MULTIKEY_MATCH = """WITH b AS (SELECT CAST(floor(s_acctbal / 100) AS BIGINT) AS k, min(s_suppkey) AS c FROM supplier GROUP BY 1), n AS (SELECT s_nationkey AS k, min(s_suppkey) AS c FROM supplier WHERE s_nationkey < 12 GROUP BY 1)
SELECT c_custkey AS record, coalesce(b.c, n.c) AS contact, CASE WHEN b.c IS NOT NULL THEN 1 ELSE 2 END::BIGINT AS rule FROM customer LEFT JOIN b ON b.k = CAST(floor(c_acctbal / 100) AS BIGINT) LEFT JOIN n ON n.k = c_nationkey WHERE coalesce(b.c, n.c) IS NOT NULL"""


def shared_key_index(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.split("text", "\n")[0]).alias("key"))
    return R.shared_keys(d, "doc_id", "key", 3)


SHARED_KEY_INDEX = "SELECT lower(string_split(text, chr(10))[1]) AS key, count(DISTINCT doc_id) AS holders FROM documents WHERE lower(string_split(text, chr(10))[1]) <> '' GROUP BY 1 HAVING holders >= 3"


def label_suggestions(spark, sf):
    c = table(spark, sf, "customer")
    # labels are blocks of customers of mostly one nation; organisations are nations
    members = c.where("c_custkey % 25 = c_nationkey OR c_custkey % 40 = 0").select(F.concat(F.lit("g"), F.col("c_custkey") % 25).alias("label"), F.col("c_custkey").alias("contact"))
    orgs = c.select(F.col("c_custkey").alias("contact"), F.col("c_nationkey").alias("org"))
    return R.suggest_members(members, orgs)


LABEL_SUGGESTIONS = """WITH m AS (SELECT concat('g', c_custkey % 25) AS label, c_custkey AS contact FROM customer WHERE c_custkey % 25 = c_nationkey OR c_custkey % 40 = 0), o AS (SELECT c_custkey AS contact, c_nationkey AS org FROM customer),
z AS (SELECT label, count(DISTINCT contact) AS z FROM m GROUP BY label), n AS (SELECT label, org, count(DISTINCT contact) AS n FROM m JOIN o USING (contact) GROUP BY ALL), k AS (SELECT label, org FROM n JOIN z USING (label) WHERE n >= 2 AND n >= 0.5 * z)
SELECT DISTINCT label, org, contact FROM k JOIN o USING (org) WHERE (label, contact) NOT IN (SELECT label, contact FROM m)"""


def unlabeled(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("contact"), "source")
    return L.unlabelled(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("contact"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


UNLABELED = "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source"


def label_stats(spark, sf):
    c = table(spark, sf, "customer")
    members = c.where("c_acctbal > 5000").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("contact"))
    orgs = c.select(F.col("c_custkey").alias("contact"), F.col("c_nationkey").alias("org"))
    s = L.label_stats(c.select(F.col("c_mktsegment").alias("label")).distinct(), members, orgs)
    return s.select("label", "members", F.array_join(F.transform(F.map_entries("orgs"), lambda e: F.concat_ws(":", e.key, e.value)), ",").alias("orgs"))


LABEL_STATS = """WITH n AS (SELECT c_mktsegment AS label, c_nationkey AS org, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL)
SELECT label, CAST(sum(n) AS BIGINT) AS members, string_agg(concat(org, ':', n), ',' ORDER BY org) AS orgs FROM n GROUP BY label"""


def key_union(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return L.key_union(a, b)


KEY_UNION = "SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders"


def key_diff(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("value")), table(spark, sf, "orders").select(F.col("o_custkey").alias("value"))
    return L.union_lists(a, b, a.limit(0), b.where("value % 2 = 0").distinct())


KEY_DIFF = "(SELECT c_custkey AS value FROM customer UNION SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0"

QUERIES = {
    "exact_dupes": (exact_dupes, EXACT_DUPES),
    "exact_pairs": (exact_pairs, EXACT_PAIRS),
    "fuzzy_dupes": (fuzzy_dupes, FUZZY_DUPES),
    "similarity_table": (similarity_table, SIMILARITY_TABLE),
    "best_match": (best_match, BEST_MATCH),
    "multikey_match": (multikey_match, MULTIKEY_MATCH),
    "shared_key_index": (shared_key_index, SHARED_KEY_INDEX),
    "label_suggestions": (label_suggestions, LABEL_SUGGESTIONS),
    "unlabeled": (unlabeled, UNLABELED),
    "label_stats": (label_stats, LABEL_STATS),
    "key_union": (key_union, KEY_UNION),
    "key_diff": (key_diff, KEY_DIFF),
}


def _spelled(key: str) -> Column:
    """A word for each key: its digits, well mixed, as letters."""
    return F.translate((F.col(key) * 7919 % 99991).cast("string"), "0123456789", "aeioubdgkm")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _customer_names(spark, sf):
    """Customers and suppliers as people: a spelled word and a segment, in either order."""
    left = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat_ws(" ", _spelled("c_custkey"), F.lower("c_mktsegment")).alias("name"), F.repeat(F.char(F.col("c_nationkey") + 97), 4).alias("org"))
    right = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.concat_ws(" ", F.lower(F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("s_suppkey") % 5 + 1).cast("int"))), _spelled("s_suppkey")).alias("name"), F.repeat(F.char(F.col("s_nationkey") + 97), 4).alias("org"))
    return left, right


def name_join(spark, sf):
    left, right = _customer_names(spark, sf)
    return R.scored_matches(left, right, 85.0).withColumn("score", F.round("score", 4))


_NAMES = """a AS (SELECT concat('c', c_custkey) AS id, concat(translate(CAST(c_custkey * 7919 % 99991 AS VARCHAR), '0123456789', 'aeioubdgkm'), ' ', lower(c_mktsegment)) AS name, repeat(chr(97 + c_nationkey), 4) AS org FROM customer),
b AS (SELECT concat('s', s_suppkey) AS key, concat(lower(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][1 + s_suppkey % 5]), ' ', translate(CAST(s_suppkey * 7919 % 99991 AS VARCHAR), '0123456789', 'aeioubdgkm')) AS name, repeat(chr(97 + s_nationkey), 4) AS org FROM supplier),
p AS (SELECT id, key, a.org = b.org AS company, a.name AS x, b.name AS y FROM a, b UNION ALL SELECT id, key, a.org = b.org, array_to_string(list_sort(string_split(a.name, ' ')), ' '), array_to_string(list_sort(string_split(b.name, ' ')), ' ') FROM a, b),
t(id, key, company, x, y, i, r) AS (SELECT id, key, company, x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT id, key, company, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM t
 WHERE i < length(x) AND 200.0 * (r[-1] + length(x) - i) >= 85 * (length(x) + length(y))),
s AS (SELECT id, key, least(100, max(200.0 * r[-1] / (length(x) + length(y))) + CASE WHEN any_value(company) THEN 15 ELSE 0 END)::DOUBLE AS score FROM t WHERE i = length(x) AND 200.0 * r[-1] >= 85 * (length(x) + length(y)) GROUP BY id, key)"""
NAME_JOIN = f"WITH RECURSIVE {_NAMES} SELECT id, key, round(score, 4) AS score FROM s"


def name_assignment(spark, sf):
    """Each customer and each supplier at most once, by both rules of order."""
    left, right = _customer_names(spark, sf)
    best, first = (pairs.select(F.lit(rule).alias("rule"), "id", "key", F.round("score", 4).alias("score")) for rule, pairs in zip(("best", "first"), R.assigned_matches(left, right, 85.0, rules=(False, True))))
    return best.unionByName(first)


NAME_ASSIGNMENT = f"""WITH RECURSIVE {_NAMES},
o AS (SELECT 'best' AS rule, list({{'id': id, 'key': key, 'score': score}} ORDER BY score DESC, id, key) AS l FROM s UNION ALL SELECT 'first', list({{'id': id, 'key': key, 'score': score}} ORDER BY id, score DESC, key) FROM s),
g(rule, n, l, ids, keys, id, key, score) AS (SELECT rule, 0, l, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM o
 UNION ALL SELECT rule, n + 1, list_filter(l, lambda c: c.id <> l[1].id AND c.key <> l[1].key), ids, keys, l[1].id, l[1].key, l[1].score FROM g WHERE len(l) > 0)
SELECT rule, id, key, round(score, 4) AS score FROM g WHERE n > 0"""


def _as_contacts(spark, sf):
    """Customers with phones and addresses that some of them share."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    phones = F.array_compact(F.array(F.concat(F.lit("+421 9"), F.lpad((k * 31 % 997).cast("string"), 8, "0")), F.when(k % 9 == 0, F.concat(F.lit("9"), F.lpad((k * 17 % 991).cast("string"), 8, "0")))))
    emails = F.array_compact(F.array(F.when(k % 4 == 0, F.concat(F.lit(" M"), k * 13 % 487, F.lit("@Acme.example"))), F.when(k % 5 == 0, F.lit(" "))))
    return c.select(F.concat(F.lit("people/c"), k).alias("resource_name"), F.when(k % 6 == 0, F.concat(F.lit("Näme "), k % 211)).alias("display_name"), phones.alias("phones"), emails.alias("emails"))


def duplicate_classes(spark, sf):
    return R.duplicate_classes(_as_contacts(spark, sf), None)


DUPLICATE_CLASSES = """WITH RECURSIVE k AS (SELECT DISTINCT concat('people/c', c_custkey) AS n, x.kind, x.key FROM (SELECT c_custkey, unnest([{'kind': 'phone', 'key': concat('9', lpad(CAST(c_custkey * 31 % 997 AS VARCHAR), 8, '0'))},
 {'kind': 'phone', 'key': CASE WHEN c_custkey % 9 = 0 THEN concat('9', lpad(CAST(c_custkey * 17 % 991 AS VARCHAR), 8, '0')) END},
 {'kind': 'email', 'key': CASE WHEN c_custkey % 4 = 0 THEN concat('m', c_custkey * 13 % 487, '@acme.example') END}, {'kind': 'name', 'key': CASE WHEN c_custkey % 6 = 0 THEN concat('name ', c_custkey % 211) END}]) AS x FROM customer) WHERE x.key IS NOT NULL),
h AS (SELECT *, count(*) OVER (PARTITION BY kind, key) - 1 AS others, min(n) OVER (PARTITION BY kind, key) AS lead FROM k),
e AS (SELECT n AS a, lead AS b FROM h WHERE others > 0 UNION SELECT lead, n FROM h WHERE others > 0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS n, min(b) AS class_id, count(*) AS members FROM r GROUP BY a),
l AS (SELECT n, coalesce(sum(others) FILTER (kind = 'phone'), 0)::BIGINT AS phone_links, coalesce(sum(others) FILTER (kind = 'email'), 0)::BIGINT AS email_links, coalesce(sum(others) FILTER (kind = 'name'), 0)::BIGINT AS name_links FROM h GROUP BY n)
SELECT n AS resource_name, class_id, members, CASE WHEN phone_links > 0 THEN 'phone' WHEN email_links > 0 THEN 'email' ELSE 'name' END AS match_type, phone_links, email_links, name_links, phone_links + email_links + name_links AS links FROM c JOIN l USING (n)"""


def tag_groups(spark, sf):
    """Segments written in several ways as tags, part names as groups."""
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    word = F.element_at(F.split("p_name", " "), 1)
    names = p.select(F.initcap("p_name").alias("name")).distinct()
    tags = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.concat(word, F.lit("er gizmos"), F.col("p_size") % 4)).alias("tag")).unionByName(c.select(F.lower("c_mktsegment").alias("tag"))).distinct()
    aliases = p.select(F.lower("p_brand").alias("alias"), F.initcap("p_name").alias("name")).limit(0).unionByName(c.select(F.initcap("c_mktsegment").alias("alias"), F.concat(F.lit("Segment "), F.length("c_mktsegment")).alias("name")).where("name <> 'Segment 9'").distinct())
    return R.resolve_tags(tags, names, aliases)


TAG_GROUPS = """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS low FROM part), g AS (SELECT low, array_to_string(list_transform(string_split(low, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS name FROM n),
t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 's') ELSE concat(string_split(p_name, ' ')[1], 'er gizmos', p_size % 4) END AS tag FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer),
p AS (SELECT tag, name, lower(tag) AS x, low AS y FROM t, g UNION ALL SELECT tag, name, array_to_string(list_sort(string_split(lower(tag), ' ')), ' '), array_to_string(list_sort(string_split(low, ' ')), ' ') FROM t, g),
m(tag, name, x, y, i, r) AS (SELECT tag, name, x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT tag, name, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN r[j] + 1 ELSE greatest(acc[-1], r[j + 1]) END), [0::INT]) FROM m
 WHERE i < length(x) AND 200.0 * (r[-1] + length(x) - i) >= 90 * (length(x) + length(y))),
s AS (SELECT tag, name FROM m WHERE i = length(x) AND 200.0 * r[-1] >= 90 * (length(x) + length(y)) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY 200.0 * r[-1] / (length(x) + length(y)) DESC, name) = 1),
al AS (SELECT DISTINCT lower(c_mktsegment) AS tag, concat('Segment ', length(c_mktsegment)) AS name FROM customer WHERE length(c_mktsegment) <> 9),
c AS (SELECT t.tag, al.name AS by_alias, g.name AS same, s.name AS close FROM t LEFT JOIN al USING (tag) LEFT JOIN g ON g.low = lower(t.tag) LEFT JOIN s ON s.tag = t.tag)
SELECT tag, coalesce(by_alias, same, close, array_to_string(list_transform(string_split(tag, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')) AS group_name, CASE WHEN by_alias IS NOT NULL THEN 'alias' WHEN same IS NOT NULL THEN 'equal' WHEN close IS NOT NULL THEN 'similar' ELSE 'create' END AS route FROM c"""

def participant_names(spark, sf):
    """Customers' spelled names, two a record, against the suppliers': the best of
    plain, token-sorted and token-set similarity at 92."""
    left, right = _customer_names(spark, sf)
    number = F.substring("id", 2, 20).cast("long")
    records = left.groupBy(F.floor(number / 2).alias("record")).agg(F.collect_list("name").alias("names"))
    return R.fuzzy_participants(records, right.select(F.col("key").alias("contact"), "name"), 92.0).withColumn("score", F.round("score", 4))


PARTICIPANT_NAMES = """WITH RECURSIVE a AS (SELECT DISTINCT c_custkey // 2 AS record, concat(translate(CAST(c_custkey * 7919 % 99991 AS VARCHAR), '0123456789', 'aeioubdgkm'), ' ', lower(c_mktsegment)) AS q FROM customer),
b AS (SELECT concat('s', s_suppkey) AS contact, concat(lower(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][1 + s_suppkey % 5]), ' ', translate(CAST(s_suppkey * 7919 % 99991 AS VARCHAR), '0123456789', 'aeioubdgkm')) AS h FROM supplier),
w AS (SELECT q, h, list_sort(list_distinct(string_split(q, ' '))) AS u, list_sort(list_distinct(string_split(h, ' '))) AS v FROM (SELECT DISTINCT q FROM a), (SELECT DISTINCT h FROM b) WHERE greatest(length(q), length(h)) < 1.5 * least(length(q), length(h))),
s AS (SELECT *, list_filter(u, lambda x: list_contains(v, x)) AS c FROM w),
k AS (SELECT q, h, array_to_string(c, ' ') AS c, array_to_string(list_concat(c, list_filter(u, lambda x: NOT list_contains(c, x))), ' ') AS l, array_to_string(list_concat(c, list_filter(v, lambda x: NOT list_contains(c, x))), ' ') AS r, array_to_string(list_sort(string_split(q, ' ')), ' ') AS sq, array_to_string(list_sort(string_split(h, ' ')), ' ') AS sh FROM s),
p AS (SELECT q, h, q AS x, h AS y, 1.0 AS scale FROM k UNION ALL SELECT q, h, sq, sh, 0.95 FROM k UNION ALL SELECT q, h, l, r, 0.95 FROM k UNION ALL SELECT q, h, c, l, 0.95 FROM k WHERE c <> '' UNION ALL SELECT q, h, c, r, 0.95 FROM k WHERE c <> ''),
t(q, h, scale, x, y, i, m) AS (SELECT q, h, scale, x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) FROM p
 UNION ALL SELECT q, h, scale, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN m[j] + 1 ELSE greatest(acc[-1], m[j + 1]) END), [0::INT]) FROM t
 WHERE i < length(x) AND scale * 200.0 * (m[-1] + length(x) - i) >= 92 * (length(x) + length(y))),
f AS (SELECT q, h, max(scale * 200.0 * m[-1] / (length(x) + length(y)))::DOUBLE AS score FROM t WHERE i = length(x) GROUP BY q, h HAVING score >= 92)
SELECT record, contact, round(score, 4) AS score FROM a JOIN f USING (q) JOIN b USING (h) QUALIFY row_number() OVER (PARTITION BY record ORDER BY score DESC, contact) = 1"""

QUERIES |= {
    "name_join": (name_join, NAME_JOIN),
    "name_assignment": (name_assignment, NAME_ASSIGNMENT),
    "duplicate_classes": (duplicate_classes, DUPLICATE_CLASSES),
    "tag_groups": (tag_groups, TAG_GROUPS),
    "participant_names": (participant_names, PARTICIPANT_NAMES),
}
