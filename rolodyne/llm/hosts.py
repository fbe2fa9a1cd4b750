"""Quality rules by host: documents that pass the rules themselves are also
judged by how often their host's documents fail.

Counts of a text come from array functions over its own words, so no text is
shuffled. Per host and rule the failing documents are counted; the rates of small
hosts are drawn towards the corpus' rate by a beta prior whose mean and strength
are fitted to all hosts (moments of the beta-binomial). A host of which some
rule's shrunk rate passes `limit` is rejected, and so are its documents. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

#: White space between words, and the characters counted as symbols.
SPACE, SYMBOL = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
#: A document fails a rule by its counts; the first two also by themselves reject it.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "odd_words": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repetitive")
#: A host whose rate of failing documents, after shrinking, is above this is rejected.
LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0


def host_of(source: Column) -> Column:
    """The host of a source: of a URL the part between :// and the next /, ?, # or
    the port, else the whole, in lower case; null where there is none."""
    rest = F.regexp_replace(F.lower(F.trim(source)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    return F.nullif(F.regexp_extract(rest, r"^([^/?#:]*)", 1), F.lit(""))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines
    and n_repeat_words.

    Windows of three words are told by 64-bit hashes of the words. The positions
    of windows found again come from a sort of each text's hashes, with the
    position in the low bits: neighbours that agree in the rest are candidates,
    and among those equal whole hashes are neighbours after a second sort. All
    steps take n log n of a text's own length."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    out = docs.withColumns({"_words": words, "_lines": lines, "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long")})
    n = F.size("_words")
    shifted = lambda k: F.slice("_words", k, F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(F.arrays_zip(shifted(1).alias("a"), shifted(2).alias("b"), shifted(3).alias("c")), lambda w: F.xxhash64(w.a, w.b, w.c))
    out = out.withColumns({"n_words": n.cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_h": hashes}).drop("_words", "_lines")
    # so many low bits hold a position; each step's array is a column of its own, made once a row
    bits = F.length(F.bin(F.size("_h")))
    out = out.withColumn("_bits", bits.cast("int"))
    keyed = F.transform("_h", lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, F.col("_bits")), F.col("_bits")) + i)
    out = out.withColumn("_k", F.sort_array(keyed))
    return out.transform(_repeats).drop("_h", "_k", "_bits")


def _neighbour(array: str, same) -> Column:
    """Items of a sorted array that are the same as the one before or after."""
    at = lambda i: F.get(array, i)
    return F.filter(array, lambda x, i: F.coalesce(same(at(i - 1), x), F.lit(False)) | F.coalesce(same(x, at(i + 1)), F.lit(False)))


def _repeats(rows: DataFrame) -> DataFrame:
    high = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    low = lambda x: x - F.call_function("shiftleft", high(x), F.col("_bits"))
    rows = rows.withColumn("_c", F.array_sort(F.transform(_neighbour("_k", lambda x, y: high(x) == high(y)), lambda x: F.struct(F.get("_h", low(x).cast("int")).alias("h"), low(x).alias("i")))))
    rows = rows.withColumn("_p", F.sort_array(F.transform(_neighbour("_c", lambda x, y: x.h == y.h), lambda x: x.i)))
    # a window covers three words, fewer where the next one begins sooner
    gaps = F.transform("_p", lambda x, i: F.least(F.coalesce(F.get("_p", i + 1) - x, F.lit(3)), F.lit(3)))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_c", "_p")


def host_rates(counted: DataFrame, host: str = "host") -> DataFrame:
    """Per host the documents and those that fail each rule."""
    fails = [F.count_if(F.expr(rule)).alias(f"f_{name}") for name, rule in RULES.items()]
    return counted.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), *fails)


def priors(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """Rule -> (a, b) of a beta distribution, by moments over all hosts: the spread
    of their rates beyond what drawing n documents would give. One row of sums
    comes to the driver."""
    sums = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")]
    for name in RULES:
        f = F.col(f"f_{name}")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f.cast("double") * f / F.col("n")).alias(f"ff_{name}")]
    row, out = rates.agg(*sums).first(), {}
    for name in RULES:
        if not row.n:
            out[name] = (0.5, 0.5)
            continue
        mean = row[f"f_{name}"] / row.n
        spread = row[f"ff_{name}"] - row[f"f_{name}"] ** 2 / row.n
        room = row.n - row.nn / row.n - (row.k - 1)
        rho = (spread / (mean * (1 - mean)) - (row.k - 1)) / room if 0 < mean < 1 and room > 0 else 0.0
        strength = min(max((1 - rho) / rho, WEAKEST), STRONGEST) if rho > 0 else STRONGEST
        out[name] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(rates: DataFrame, limit: float = LIMIT) -> DataFrame:
    """rates with the shrunk rate of each rule (r_...) and rejected."""
    prior = priors(rates)
    shrunk = {f"r_{name}": (F.col(f"f_{name}") + a) / (F.col("n") + (a + b)) for name, (a, b) in prior.items()}
    out = rates.withColumns(shrunk)
    return out.withColumn("rejected", F.greatest(*(F.col(f"r_{name}") for name in RULES), F.lit(0.0)) > limit)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """-> (id_col, host, counts, base_failed, kept), one row per row of docs.

    Null texts have no words and fail; rows of a null or empty source have no host
    and are judged by themselves alone; repeated rows and ids count and come back
    as often as they are there. The counts are written once, without the texts;
    hosts are counted with a map-side part, and the verdicts of rejected hosts
    joined by exchanges that Spark splits where a host holds many rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), host_of(F.col(source_col).cast("string")).alias("host"))
    counted = materialize(text_counts(rows, "_text").drop("_text").withColumn("base_failed", F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))))
    bad = materialize(host_verdicts(materialize(host_rates(counted)), limit).where("rejected").select(F.col("host").alias("_host"), "rejected"))
    joined = counted.join(bad, counted.host == F.col("_host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull()).drop("_host", "rejected").withColumnRenamed("_id", id_col)


def op12_host_rules(spark, sf_dir):
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SPLIT = "string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')"
OP12_HOST_RULES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, nullif(lower(trim(source)), '') AS host FROM documents),
w AS (SELECT *, list_filter({_SPLIT}, lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
c AS (SELECT r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) AS s FROM w),
p AS (SELECT r, i FROM t QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
q AS (SELECT r, sum(g)::BIGINT AS n_repeat_words FROM (SELECT r, least(coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3), 3) AS g FROM p) GROUP BY r),
a AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
k AS (SELECT host, u.name AS name, count(*)::DOUBLE AS n, count(*) FILTER (u.f)::DOUBLE AS f FROM (SELECT host, unnest([{", ".join(f"{{'name': '{name}', 'f': {rule}}}" for name, rule in RULES.items())}]) AS u FROM b WHERE host IS NOT NULL) GROUP BY ALL),
m AS (SELECT name, count(*) - 1 AS k1, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) ** 2 / sum(n) AS spread FROM k GROUP BY name),
o AS (SELECT name, mean, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n - k1 > 0 THEN (spread / (mean * (1 - mean)) - k1) / (n - nn / n - k1) ELSE 0 END AS rho FROM m),
s AS (SELECT name, mean, CASE WHEN rho > 0 THEN least(greatest((1 - rho) / rho, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END AS strength FROM o),
x AS (SELECT DISTINCT host FROM k JOIN s USING (name) WHERE (f + mean * strength) / (n + strength) > {LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host NOT IN (SELECT host FROM x), true) AS kept FROM b"""
