"""URL filter: explicit rules first, then a ratio of character language models.

Two variable-order Markov models are estimated, one from accepted and one from
rejected URLs, with Witten-Bell interpolation from order ORDER down to a uniform
distribution. A URL that no rule decides is blocked when its log-likelihood
difference (rejected less accepted) per character is above a threshold.

Labelled examples are names of hosts, given by the caller (a table of names or
URLs with a label, of which LABELLED are used) or made by a rule from listed words
of either kind beside words that both have. Each is put in place of the own name
in URLs of the table. Accepted examples are these and, at the same weight, the
table's URLs, unlabelled and mostly good. So that a bad host doesn't vouch for
itself, hosts and names are dealt over two halves, and each half is judged by the
models of the other one. Those judgements of URLs that the models haven't seen
calibrate the threshold; URLs above it are taken out of the accepted examples, and
both models are estimated again.

Counts run over all URLs of the table, distributed, with a map-side part. URLs
are written in an alphabet of 48 symbols, so that all counts and the table of
log ratios have at most 48**4 entries a half however long the table is; that
bound makes it safe to gather and send to the workers. The driver holds few such
tables at a time and works on them by parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

ORDER = 3
#: The symbols of the models; beside them one for the front and one for all other bytes.
LETTERS, MARKS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "/.-_?=&#:%", "0123456789"
START, OTHER = 0, 1
SYMBOLS = 2 + len(LETTERS) + len(MARKS) + len(DIGITS)
#: The rules of the query: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Fixed values, defaults where no labels are given: words of rejected hosts (gambling,
#: drugs, sex, credit, goods, advertising, fraud), of accepted ones, and words beside both.
REJECTED = (
    "casino poker slots slot bets bet betting jackpot lotto lottery roulette blackjack bingo gambling wager bookie vegas baccarat "
    "pills pill pharma pharmacy viagra cialis levitra xanax tramadol steroids weightloss diet keto "
    "porn porno xxx adult sex sexy nude naked cams webcam escort dating hookup milf fetish erotic "
    "loans loan payday cash credit debt forex bitcoin profit earn rich money "
    "replica fake rolex handbags knockoff coupon discount outlet deals sale "
    "ads ad adserver adtrack banner popup popunder track tracker tracking clicks click traffic affiliate "
    "spam scam phish phishing malware virus warez crack keygen serial torrent hack cheats leaked"
).split()
ACCEPTED = (
    "library university college school academy institute museum archive history science physics chemistry biology math journal research study lecture "
    "news press times post daily herald magazine weather radio television film cinema music concert theatre art design photo gallery book reader story "
    "travel hotel hotels ticket tickets flight train bus road map city town village county council government ministry court law police tax "
    "health hospital clinic doctor nurse care family child parent garden kitchen recipe food bread coffee wine farm nature animal bird forest river "
    "code developer software linux server database network cloud docs wiki forum user users answer question help support learn course "
    "sport football tennis running cycling swimming chess game games puzzle shop store market bank insurance energy water power house home office "
    "church charity club society union labour trade industry machine car motor boat alarm security camera"
).split()
BESIDE = "free cheap best hot hotter online live top win super my the big farm zone club x go get buy now new all world web net center club24 24 365 777 100 land hub plus pro one".split()
#: First labels of a host that say nothing about whose it is.
GENERIC = r"^(?:www\d*|m|mobile|blog|shop|news)\."
#: URLs of the table whose names are replaced, how often each labelled name is used,
#: and how many labelled names of either kind are taken from a given table.
TEMPLATES, USES, LABELLED = 1000, 3, 20_000
#: So many URLs of labelled names are encoded at once.
AT_ONCE = 2000
EVIDENCE = 30
#: So large a share of accepted names of unknown words is blocked at most.
WRONGLY = 0.1

_symbol = np.full(256, OTHER, np.uint8)
for _k, _c in enumerate(LETTERS + MARKS + DIGITS):
    _symbol[ord(_c)] = _symbol[ord(_c.upper())] = 2 + _k


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path:
    from there up to ? # or the end. Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host is the URL's or a parent domain, and
    the URL's path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _half(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & 1


def made_names(words: list[str]) -> list[tuple[str, int]]:
    """Names of hosts from words of one kind: alone, beside a word that tells
    nothing, and two by two; each with the half of its words, so that no word is
    in names of both halves."""
    out = {(w, _half(w)) for w in words}
    for h in (0, 1):
        own = [w for w in words if _half(w) == h]
        pairs = [(a, b) for a in own for b in BESIDE] + [(a, own[(k + step) % len(own)]) for k, a in enumerate(own) for step in (1, 7, 23, 41)]
        out |= {(x, h) for a, b in pairs if a != b for x in (f"{a}-{b}", f"{b}-{a}", a + b, b + a)}
    return sorted(out)


def labelled_names(labels: DataFrame | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Accepted and rejected names, each with its half. labels: (name, label), label 1 for rejected
    ones; of names with :// their host's own name counts. LABELLED of either kind
    are drawn by a hash; without any of a kind the listed words stand for it."""
    default = made_names(ACCEPTED), made_names(REJECTED)
    if labels is None:
        return default
    host = host_path(F.col("name"))[0]
    rows = labels.select(lower_ascii(F.when(F.instr("name", "://") > 0, own_name(host)).otherwise(F.col("name"))).alias("name"), F.col("label").cast("int").alias("label")).where("name <> '' and label in (0, 1)").distinct()
    out = []
    for kind in (0, 1):
        names = rows.where(F.col("label") == kind).orderBy(F.xxhash64("name"), "name").limit(LABELLED).collect()  # LABELLED rows
        out.append(sorted((r.name, _half(r.name)) for r in names) or default[kind])
    return out[0], out[1]


def own_name(host: Column) -> Column:
    """The first label of a host that isn't generic."""
    return F.regexp_extract(F.regexp_replace(host, GENERIC, ""), r"^([^.]*)", 1)


def named_urls(names: list[tuple[str, int]], templates: list[tuple[str, str]], uses: int = USES) -> tuple[list[str], list[int]]:
    """Names and (before, after the own name) of some URLs -> URLs and the half of each."""
    names = names * uses
    templates = templates or [("http://www.", ".com/")]
    step = 7919  # a prime, so that names and templates meet in many combinations
    chosen = [templates[k * step % len(templates)] for k in range(len(names))]
    return [f"{before}{n}{after}" for (n, _), (before, after) in zip(names, chosen)], [h for _, h in names]


def encode(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """URLs -> codes of the ORDER symbols before each symbol and the symbol
    itself (START fills up the front), and how many symbols each URL has."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    total = int(size.sum())
    first = np.cumsum(size) - size
    place = np.arange(total) + ORDER * (np.repeat(np.arange(len(raw)), size) + 1)
    padded = np.full(total + ORDER * len(raw), START, np.int64)
    padded[place] = _symbol[np.frombuffer(b"".join(raw), np.uint8)]
    code = np.zeros(total, np.int64)
    for k in range(ORDER, -1, -1):
        code = code * SYMBOLS + padded[place - k]
    return code, size


def gram_counts(urls: DataFrame) -> DataFrame:
    """(url, half) -> (code, half, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, half = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            code, size = encode(text)
            both, n = np.unique(code * 2 + np.repeat(half, size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both // 2), pa.array((both % 2).astype(np.int32)), pa.array(n)], ["code", "half", "n"])

    return urls.mapInArrow(run, "code long, half int, n long").groupBy("code", "half").agg(F.sum("n").alias("n"))


def _log_parts(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Witten-Bell interpolation over all orders: log P(symbol | ORDER symbols), a
    part for each first symbol."""

    def smoothed(n: np.ndarray, low: np.ndarray) -> np.ndarray:
        total = n.sum(axis=-1, keepdims=True)
        kinds = np.maximum((n > 0).sum(axis=-1, keepdims=True), 1)
        return (n + kinds * low) / (total + kinds)

    low = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER):
        low = smoothed(counts.reshape(-1, *[SYMBOLS] * (order + 1)).sum(axis=0), low)
    for n in counts.reshape([SYMBOLS] * (ORDER + 1)):
        yield np.log(smoothed(n, low)).ravel()


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(list(_log_parts(counts)))


def ratios(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    out = np.empty(SYMBOLS ** (ORDER + 1), np.float32)
    for part, good, bad in zip(out.reshape(SYMBOLS, -1), _log_parts(accepted), _log_parts(rejected)):
        part[:] = bad - good
    return out


def score(ratio: np.ndarray, urls: list[str]) -> np.ndarray:
    """Log-likelihood difference per symbol, where EVIDENCE symbols that tell
    nothing are added to each URL, as a short one says little; 0 for an empty URL."""
    if len(urls) > AT_ONCE:
        return np.concatenate([score(ratio, urls[at : at + AT_ONCE]) for at in range(0, len(urls), AT_ONCE)])
    code, size = encode(urls)
    out, real = np.zeros(len(urls)), size > 0
    if real.any():
        out[real] = np.add.reduceat(ratio[code].astype(np.float64), (np.cumsum(size) - size)[real]) / (size[real] + EVIDENCE)
    return out


def scored(urls: DataFrame, send: Broadcast) -> DataFrame:
    """(url, half, ...) -> with column lm_score, by the table of log ratios of its
    half; they are sent, SYMBOLS**(ORDER + 1) entries a half."""

    @F.pandas_udf("double")
    def judge_batch(url: pd.Series, half: pd.Series) -> pd.Series:
        text, half = url.fillna("").tolist(), half.to_numpy()
        per = [score(t, text) for t in send.value]
        return pd.Series(np.choose(half, per) if len(per) > 1 else per[0])

    return urls.withColumn("lm_score", judge_batch("url", "half"))


def _table(counts: DataFrame, halves: int) -> np.ndarray:
    out = np.zeros(halves * SYMBOLS ** (ORDER + 1), np.float32)
    place = F.col("half") * SYMBOLS ** (ORDER + 1) + F.col("code")
    for b in counts.select(place.cast("int").alias("at"), F.col("n").cast("float")).toArrow().to_batches():  # at most SYMBOLS**(ORDER + 1) rows a half, of 8 bytes
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.reshape(halves, -1)


#: Codes of grams, in order, and how often each is there.
Grams = tuple[np.ndarray, np.ndarray]


def _grams(urls: list[str]) -> Grams:
    code, n = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(urls), AT_ONCE):
        more, times = np.unique(encode(urls[at : at + AT_ONCE])[0], return_counts=True)
        code, where = np.unique(np.concatenate((code, more)), return_inverse=True)
        n = np.bincount(where, np.concatenate((n, times)))
    return code, n


class UrlModel:
    """Log ratios of all grams, and the threshold per symbol."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def fit(urls: DataFrame, labels: DataFrame | None = None) -> UrlModel | None:
    """(url), labels (see labelled_names) -> model, or None without any URL that
    has a host. The threshold lies where the halves' judgements of rejected and of
    accepted examples, each by the other half's models, are told apart best
    (balanced accuracy)."""
    host, _ = host_path(F.col("url"))
    rows = urls.select("url", host.alias("host")).where("host <> ''").withColumn("name", own_name(F.col("host")))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("name"), F.lit(2)).cast("int"))
    at = F.instr(F.lower("url"), F.concat(F.lit("://"), F.col("host"))) + 3 + F.length("host") - F.length(F.regexp_replace("host", GENERIC, ""))
    some = rows.where("name <> ''").select("url", at.alias("at"), F.length("name").alias("n")).distinct().orderBy(F.xxhash64("url"), "url").limit(TEMPLATES)
    templates = [(r.url[: r.at - 1], r.url[r.at - 1 + r.n :]) for r in some.collect()]  # TEMPLATES rows
    examples, labelled = [], []
    for names in labelled_names(labels):
        made, half = named_urls(names, templates)
        examples.append([[u for u, x in zip(made, half) if x == h] for h in (0, 1)])
        labelled.append([_grams(own) for own in examples[-1]])
    vouched, rejected = labelled
    table = _table(gram_counts(rows.select("url", "half")), 2)
    if not table.any():
        return None
    # a half of the table is judged with the other half's URLs and all labelled names,
    # a half of the names without any name of their words
    step, judged_names = 200.0, ([], [])
    for h in (0, 1):
        ratio = ratios(_balanced([vouched[1 - h]], table[1 - h]), _counted([rejected[1 - h]]))
        for out, halves in zip(judged_names, examples):
            out.append(score(ratio, halves[h]))
    ratio = None
    tables = np.empty_like(table)
    for h in (0, 1):
        tables[h] = ratios(_balanced(vouched, table[1 - h]), _counted(rejected))
    send = urls.sparkSession.sparkContext.broadcast(tables)
    judged = scored(rows.select("url", "half"), send)
    binned = judged.groupBy(F.floor(F.col("lm_score") * step).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("b")  # scores are within -+ log(SYMBOLS) or so: some thousand rows
    allowed, found = (np.sort(np.floor(np.concatenate(x) * step)) for x in judged_names)
    edges = np.unique(np.concatenate((binned.b.to_numpy(), found, allowed)))
    upto = np.concatenate(([0], np.cumsum(binned.n.to_numpy())))
    good = upto[np.searchsorted(binned.b.to_numpy(), edges)] / binned.n.sum()
    # errors on labelled accepted names, of which the models know no word, stay below WRONGLY
    fewest = 1 - np.searchsorted(allowed, edges) / max(1, len(allowed)) <= WRONGLY
    gain = np.where(fewest, good + 1 - np.searchsorted(found, edges) / max(1, len(found)), -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    threshold = float((edges[best[0]] + edges[best[-1]]) / 2 / step)
    table = table[0] + table[1]
    kept = _table(gram_counts(judged.where(F.col("lm_score") <= threshold).select("url", F.lit(0).alias("half"))), 1)[0]
    send.destroy()
    return UrlModel(ratios(_balanced(vouched, kept if kept.any() else table), _counted(rejected)), threshold)


def _counted(labelled: list[Grams]) -> np.ndarray:
    out = np.zeros(SYMBOLS ** (ORDER + 1), np.float32)
    for code, n in labelled:
        out[code] += n.astype(np.float32)
    return out


def _balanced(labelled: list[Grams], table: np.ndarray) -> np.ndarray:
    """Counts of labelled examples and of the table together, so that the table,
    however long, weighs as much as the labels."""
    out = _counted(labelled)
    out += table * np.float32(min(1.0, sum(n.sum() for _, n in labelled) / max(1.0, table.sum(dtype=np.float64))))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """-> (page_id, host, path, rule, verdict, lm_score). A rule decides where
    one fits; else the models do, learned from `labels` or the listed words. URLs that are null, empty or without a host are
    allowed where no rule fits them; without any host in the table, so is all
    that no rule decides. Repeated rows and ids are judged alike."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    model = fit(rows.where("url is not null").select("url"), labels)
    if model is None:
        with_score, threshold = rows.withColumn("lm_score", F.lit(0.0)), float("inf")
    else:
        send = pages.sparkSession.sparkContext.broadcast(model.ratio[None])
        with_score, threshold = scored(rows.withColumn("half", F.lit(0)), send), model.threshold
    found = with_score.select("page_id", host.alias("host"), path.alias("path"), "lm_score").withColumn("rule", match_rules(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r, v in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    by_model = F.when((F.col("host") != "") & (F.col("lm_score") > F.lit(threshold)), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", F.coalesce(by_rule, by_model)).select("page_id", "host", "path", "rule", "verdict", "lm_score")


def op8_urls(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "pages"))
