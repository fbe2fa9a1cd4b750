"""Text, mask and URL queries on documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import text as T
from ..session import table


def email_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.emails_in(F.col("text")).alias("found"))
    return d.where(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", ",").alias("emails"))


EMAIL_EXTRACT = f"WITH f AS (SELECT doc_id, regexp_extract_all(text, '{T.EMAIL}') AS f FROM documents) SELECT doc_id, len(f) AS n, array_to_string(f, ',') AS emails FROM f WHERE len(f) > 0"


def phone_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(f"({T.PHONES[0]})"), 1).alias("found"))
    return d.where(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join(F.transform("found", lambda x: F.regexp_replace(x, r"\D", "")), ",").alias("phones"))


PHONE_EXTRACT = f"WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{T.PHONES[0]}'), lambda x: regexp_replace(x, '\\D', '', 'g')) AS f FROM documents) SELECT doc_id, len(f) AS n, array_to_string(f, ',') AS phones FROM f WHERE len(f) > 0"


def links_in_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.urls_in(F.concat_ws(" ", "url", F.col("html"))).alias("found"))
    return p.select("page_id", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "\n")).alias("links_md5"))


_URL = T.URL.replace("'", "''")
LINKS_IN_TEXT = f"SELECT page_id, len(f) AS n, md5(array_to_string(f, chr(10))) AS links_md5 FROM (SELECT page_id, regexp_extract_all(concat_ws(' ', url, html), '{_URL}') AS f FROM pages)"


def mask_pii(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").contains("@"))
    return d.select("doc_id", F.md5(M.mask_email(F.col("text"))).alias("masked_md5"))


MASK_PII = r"SELECT doc_id, md5(regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9])[A-Za-z0-9.-]*(\.[A-Za-z]{2,})', '\1***@\2***\3', 'g')) AS masked_md5 FROM documents WHERE contains(text, '@')"


def mask_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", M.mask_last_name(F.col("p_name")).alias("last"), M.mask_name(F.col("p_name")).alias("all_names"))


MASK_NAMES = r"SELECT p_partkey, regexp_replace(p_name, '^(\S+)\s+(?:.*\s)?(\S)\S*$', '\1 \2.') AS last, regexp_replace(p_name, '(\pL)\pL*', '\1***', 'g') AS all_names FROM part"


def ascii_fold(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"))


ASCII_FOLD = "SELECT doc_id, md5(strip_accents(" + "".join("replace(" for _ in T.DOUBLE) + "text" + "".join(f", '{a}', '{b}')" for a, b in T.DOUBLE.items()) + ")) AS folded_md5 FROM documents"


def casing_flags(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_all_caps(F.col("line"))).alias("caps"), F.count_if(T.is_all_lower(F.col("line"))).alias("low"))


CASING_FLAGS = r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[^\p{L}]', '', 'g') AS x FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(x) >= 2 AND x = upper(x) AND x <> lower(x)) AS caps, count(*) FILTER (length(x) >= 2 AND x = lower(x) AND x <> upper(x)) AS low FROM l GROUP BY doc_id"""


def title_case(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.title_case(F.concat_ws(" ", "p_name", F.lit("of the"), F.lower("p_type"))).alias("title"))


TITLE_CASE = f"""WITH w AS (SELECT p_partkey, string_split(lower(concat_ws(' ', p_name, 'of the', lower(p_type))), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({', '.join(repr(x) for x in T.PARTICLES)}) THEN x ELSE array_to_string(list_transform(string_split(x, '-'), lambda y: concat(upper(y[1]), y[2:])), '-') END), ' ') AS title FROM w"""

_WORDS = ["the", "of", "that", "les", "und", "que"]


def keyword_hits(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.keyword_hits(F.col("text"), _WORDS).cast("long").alias("hits"))


KEYWORD_HITS = "SELECT doc_id, CAST(" + " + ".join(rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')::INT" for w in _WORDS) + " AS BIGINT) AS hits FROM documents"


def url_classify(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(T.url_type(F.col("url")).alias("type"), F.coalesce(F.col("url").contains("utm_"), F.lit(False)).alias("tracked")).agg(F.count(F.lit(1)).alias("n"))


URL_CLASSIFY = """SELECT CASE WHEN contains(u, 'linkedin.com') THEN 'linkedin' WHEN contains(u, 'facebook.com') OR contains(u, 'fb.com') THEN 'facebook' WHEN contains(u, 'twitter.com') OR contains(u, 'x.com') THEN 'twitter'
 WHEN contains(u, 'instagram.com') THEN 'instagram' WHEN contains(u, 'github.com') THEN 'github' ELSE 'website' END AS type, coalesce(contains(url, 'utm_'), false) AS tracked, count(*) AS n
FROM (SELECT url, lower(coalesce(url, '')) AS u FROM pages) GROUP BY ALL"""


def url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


URL_HOST = r"SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages"


def phone_postcode_rules(spark, sf):
    c = table(spark, sf, "customer")
    code = F.when(F.col("c_custkey") % 7 == 0, F.lit("12-34")).otherwise(F.lpad((F.col("c_custkey") * 7919 % 100000).cast("string"), 5, "0"))
    p = T.postal_code(code)
    return c.select("c_custkey", p.formatted.alias("formatted"), p.country.alias("country"))


PHONE_POSTCODE_RULES = r"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '12-34' ELSE lpad((c_custkey * 7919 % 100000)::VARCHAR, 5, '0') END AS p FROM customer),
d AS (SELECT *, regexp_replace(p, '\D', '', 'g') AS d FROM c)
SELECT c_custkey, CASE WHEN length(d) = 5 THEN concat(d[1:3], ' ', d[4:5]) ELSE p END AS formatted, CASE WHEN length(d) <> 5 THEN '' WHEN d[1] IN ('0','8','9') THEN 'SK' ELSE 'CZ' END AS country FROM d"""


def interaction_ids(spark, sf):
    m = table(spark, sf, "conversations")
    return m.select("conv_id", "turn", T.short_id(F.col("conv_id"), F.col("turn"), F.col("role")).alias("interaction_id"), F.length(T.truncate(F.col("text"))).cast("long").alias("size"))


INTERACTION_IDS = "SELECT conv_id, turn, substr(sha256(concat_ws('|', conv_id::VARCHAR, turn::VARCHAR, coalesce(role, ''))), 1, 16) AS interaction_id, least(length(text), 500) AS size FROM conversations"


def hashtags(spark, sf):
    tagged = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.regexp_replace("p_name", " ", " #"), F.lit(" #"), "p_type", F.lit(" #"), F.lower("p_type")).alias("note"))
    return tagged.select("p_partkey", F.array_join(T.hashtags(F.col("note")), ",").alias("tags"))


HASHTAGS = r"""WITH n AS (SELECT p_partkey, list_transform(regexp_extract_all(concat('#', replace(p_name, ' ', ' #'), ' #', p_type, ' #', lower(p_type)), '#([\p{L}\p{N}_-]+)', 1), lambda x: lower(x)) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags FROM n"""


def email_names(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("."), F.lit("lee"), F.col("c_custkey") % 10, F.lit("@"), F.when(F.col("c_custkey") % 3 == 0, "gmail.com").otherwise("acme.example")).alias("mail"))
    n = T.name_from_email(F.col("mail"))
    return c.select("c_custkey", n.given.alias("given"), n.family.alias("family"), T.company_domain(F.col("mail")).alias("company"))


EMAIL_NAMES = """SELECT c_custkey, concat(upper(lower(c_mktsegment)[1]), lower(c_mktsegment)[2:]) AS given, 'Lee' AS family, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'acme.example' END AS company FROM customer"""

QUERIES = {
    "email_extract": (email_extract, EMAIL_EXTRACT),
    "phone_extract": (phone_extract, PHONE_EXTRACT),
    "links_in_text": (links_in_text, LINKS_IN_TEXT),
    "mask_pii": (mask_pii, MASK_PII),
    "mask_names": (mask_names, MASK_NAMES),
    "ascii_fold": (ascii_fold, ASCII_FOLD),
    "casing_flags": (casing_flags, CASING_FLAGS),
    "title_case": (title_case, TITLE_CASE),
    "keyword_hits": (keyword_hits, KEYWORD_HITS),
    "url_classify": (url_classify, URL_CLASSIFY),
    "url_host": (url_host, URL_HOST),
    "phone_postcode_rules": (phone_postcode_rules, PHONE_POSTCODE_RULES),
    "interaction_ids": (interaction_ids, INTERACTION_IDS),
    "hashtags": (hashtags, HASHTAGS),
    "email_names": (email_names, EMAIL_NAMES),
}
