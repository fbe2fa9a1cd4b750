"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to, one to one.
ACCENTED = "áàâäãåāăąæçćčďđéèêëēėęěíìîïīįıķĺľļłñńňņóòôöõøōőœŕřśšşșťţțúùûüūůűųýÿźżžÁÀÂÄÃÅĀĂĄÇĆČĎĐÉÈÊËĒĖĘĚÍÌÎÏĪĮĶĹĽĻŁÑŃŇŅÓÒÔÖÕØŌŐŔŘŚŠŞȘŤŢȚÚÙÛÜŪŮŰŲÝŸŹŻŽ"
#: Letters that fold to two.
DOUBLE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
#: Particles that stay lower case within a title.
PARTICLES = ["a", "and", "da", "de", "der", "di", "do", "du", "la", "le", "na", "of", "s", "the", "v", "van", "von", "y", "z"]
#: Free mail domains, a seed that callers may replace.
FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "seznam.cz", "azet.sk", "centrum.sk", "proton.me", "gmx.de"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"')\]]+"
#: Patterns for phone numbers in running text, in order of preference.
PHONES = [r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}", r"\b00\d{1,3}(?:[ .-]?\d{2,4}){2,4}", r"(?<![\d+])0\d{2,3}[ /.-]?\d{3}[ .-]?\d{3}\b", r"(?<![\d+])(?<!\d[ .-])\d{3}[ .-]\d{3}[ .-]\d{3}(?![ .-]?\d)", r"(?<!\d)0\d/\d{3,4}[ .-]?\d{2}[ .-]?\d{2}\b"]


def _fold_tables() -> tuple[str, str]:
    """One-to-one folding pairs by canonical decomposition of the letters above."""
    import unicodedata

    # letters with a stroke or without a dot have no decomposition
    odd = {"đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ı": "i"}
    source, target = [], []
    for c in ACCENTED:
        base = odd.get(c) or unicodedata.normalize("NFD", c)[0]
        if base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _fold_tables()


def let(value: Column, body) -> Column:
    """body(value) with the value bound once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column | str) -> Column:
    """Missing, null and empty are one value."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def fold(c: Column) -> Column:
    """ASCII form of Latin text, case kept."""
    for a, b in DOUBLE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _FROM, _TO)


def compare_key(c: Column) -> Column:
    """Folded, lower case, single spaces: equal keys are equal names."""
    return squeeze(F.lower(fold(text(c))))


def title_case(c: Column, particles: list[str] = PARTICLES) -> Column:
    """First letter of each word upper, the rest lower; particles stay lower
    unless first; parts joined by hyphens are words of their own."""
    words = F.split(F.lower(c), " ")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))
    hyphen = lambda w: F.array_join(F.transform(F.split(w, "-"), cap), "-")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(particles), w).otherwise(hyphen(w))), " ")


def letters(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^\p{L}]", "")


def is_all_caps(c: Column) -> Column:
    """At least two letters, all upper case."""
    x = letters(c)
    return (F.length(x) >= 2) & (x == F.upper(x)) & (x != F.lower(x))


def is_all_lower(c: Column) -> Column:
    x = letters(c)
    return (F.length(x) >= 2) & (x == F.lower(x)) & (x != F.upper(x))


def emails_in(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(f"({EMAIL})"), 1)


def urls_in(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(f"({URL})"), 1)


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def distinct_by(values: Column, key) -> Column:
    """Elements whose key(element) hasn't come before, in order."""
    def pick(vs: Column) -> Column:
        return let(F.transform(vs, key), lambda keys: F.filter(vs, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))

    return let(values, pick)


def phones_in(c: Column, patterns: list[str] = PHONES) -> Column:
    """All patterns' matches, pattern by pattern, the first of equal digits kept."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text(c), F.lit(f"({p})"), 1) for p in patterns)))
    return distinct_by(F.transform(found, lambda x: F.trim(x)), lambda x: F.regexp_replace(x, r"\D", ""))


def email_domain(c: Column) -> Column:
    return F.lower(F.element_at(F.split(text(c), "@"), -1))


def company_domain(c: Column, free: list[str] = FREE_DOMAINS) -> Column:
    """Domain of a company address; null for free mail, no @ or a one-letter name."""
    d = email_domain(c)
    label = F.element_at(F.split(d, r"\."), 1)
    return F.when(text(c).contains("@") & ~d.isin(free) & (F.length(label) >= 2) & d.contains("."), d)


def name_from_email(c: Column) -> Column:
    """struct(given, family) from first.last@..., null where it isn't two names."""
    local = F.regexp_replace(F.lower(F.split(text(c), "@")[0]), r"^\d+|\d+$", "")
    pattern = r"^(\p{L}{2,})[._-](\p{L}{2,})$"
    return F.when(local.rlike(pattern), F.struct(F.initcap(F.regexp_extract(local, pattern, 1)).alias("given"), F.initcap(F.regexp_extract(local, pattern, 2)).alias("family")))


def display_name(names: Column) -> Column:
    """First of display, given + family, unstructured name that isn't empty."""
    n = F.try_element_at(names, F.lit(1))
    full = F.trim(F.concat_ws(" ", n.givenName, n.familyName))
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (n.displayName, full, n.unstructuredName)))


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur as whole words (Unicode boundaries)."""
    low = F.lower(text(c))
    # the literal comes first, so that most places are ruled out by one character
    hit = lambda c, k: c.rlike(rf"\Q{k}\E(?![\p{{L}}\p{{N}}_])(?<![\p{{L}}\p{{N}}_]\Q{k}\E)").cast("int")
    return let(low, lambda c: sum((hit(c, k) for k in keywords), F.lit(0)))


def truncate(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def short_id(*cols: Column, size: int = 16) -> Column:
    """First characters of the SHA-256 of the values joined by |; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(text(c.cast("string")) for c in cols)), 256), 1, size)


def parse_instant(c: Column) -> Column:
    """ISO text to a UTC timestamp; without a zone it is UTC; else null."""
    return F.try_to_timestamp(F.trim(text(c)))


def apple_time(ns: Column) -> Column:
    """Nanoseconds since 2001-01-01 UTC to a timestamp, in whole numbers throughout."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)) + F.lit(978_307_200_000_000))


def to_apple_time(ts: Column) -> Column:
    return (F.unix_micros(ts) - F.lit(978_307_200_000_000)) * 1000


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"#([\p{L}\p{N}_-]+)"), 1), lambda x: F.lower(x)))


def merge_tags(old: Column, new: Column) -> Column:
    """Old tags, then the new ones that differ from all before but for case."""
    return distinct_by(F.concat(F.coalesce(old, F.array().cast("array<string>")), new), lambda x: F.lower(x))


def postal_code(c: Column) -> Column:
    """struct(formatted, country): five digits as XXX XX; 0, 8, 9 are SK, 1 to 7 CZ; else unchanged and empty."""
    d = digits(c)
    good = F.length(d) == 5
    first = F.substring(d, 1, 1)
    return F.struct(F.when(good, F.concat(F.substring(d, 1, 3), F.lit(" "), F.substring(d, 4, 2))).otherwise(c).alias("formatted"), F.when(good, F.when(first.isin("0", "8", "9"), F.lit("SK")).otherwise(F.lit("CZ"))).otherwise(F.lit("")).alias("country"))


def clean_email(c: Column) -> Column:
    """struct(value, confidence, valid): invisible characters out, lower case, checked."""
    v = F.lower(F.trim(F.regexp_replace(text(c), "[\\s​‌‍⁠﻿­]", "")))
    valid = lambda x: x.rlike(rf"^(?!\.)(?!.*\.\.){EMAIL}$") & ~x.contains(".@")
    return let(v, lambda x: F.struct(x.alias("value"), F.when(valid(x), 0.95).otherwise(0.5).alias("confidence"), valid(x).alias("valid")))


def domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"^www\.", "")


def url_host(url: Column) -> Column:
    return domain(F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def url_type(url: Column) -> Column:
    """Service by substring, in this order; a plain website otherwise."""
    low, out = F.lower(text(url)), F.lit("website")
    for name, marks in reversed([("linkedin", ["linkedin.com"]), ("facebook", ["facebook.com", "fb.com"]), ("twitter", ["twitter.com", "x.com"]), ("instagram", ["instagram.com"]), ("github", ["github.com"])]):
        hit = low.contains(marks[0])
        for m in marks[1:]:
            hit = hit | low.contains(m)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def profile_url(url: Column) -> Column:
    """Profile address without query, fragment and trailing slash, https and www."""
    slug = F.regexp_extract(text(url), r"(?i)linkedin\.com/in/([^/?#]+)", 1)
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/in/"), F.lower(slug)))


def address_key(street: Column, city: Column, postal: Column, formatted: Column) -> Column:
    """Lower-case street|city|postal; the formatted value where all are empty."""
    part = lambda x: F.nullif(squeeze(F.lower(text(x))), F.lit(""))
    joined = F.concat_ws("|", part(street), part(city), part(postal))
    return F.when(joined != "", joined).otherwise(F.coalesce(part(formatted), F.lit("")))


def legal_ids(c: Column) -> Column:
    """struct(company_id, tax_id, vat_id) as labelled in a note; first match each."""
    one = lambda p: F.nullif(F.regexp_extract(text(c), p, 1), F.lit(""))
    return F.struct(
        one(r"(?i)\bI[ČC]O?[:\s]*(\d{8})\b").alias("company_id"),
        one(r"(?i)\bDI[ČC][:\s]*(\d{10})\b").alias("tax_id"),
        F.upper(one(r"(?i)\b((?:SK|CZ)\d{8,10})\b")).alias("vat_id"),
    )


#: Ways a date is written in notes, and which group is year, month, day.
DATES = [(r"\b(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})\b", (3, 2, 1)), (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 2, 1)), (r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b", (3, 2, 1))]
#: Words near a date that tell what it is.
OCCASIONS = [("birthday", ["birthday", "born", "narod", "nar."]), ("nameday", ["name day", "nameday", "meniny"]), ("anniversary", ["anniversary", "wedding", "výroč"])]


def dates_in(c: Column, latest_year: int) -> Column:
    """Dates in a text, pattern by pattern, as array of struct(raw, date, occasion):
    the date in ISO form, months and days only checked for range; the words from 40
    characters before it to 20 after tell the occasion."""

    def of(pattern: str, order: tuple[int, int, int], whole: Column) -> Column:
        found = F.regexp_extract_all(whole, F.lit(f"({pattern})"), 1)
        # where each begins: what stands before it, and the dates before
        between = F.transform(F.split(whole, pattern, -1), lambda x: F.length(x))
        sizes = F.transform(found, lambda x: F.length(x))

        def one(raw: Column, i: Column, parts: Column, lengths: Column) -> Column:
            total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, b: a + b)
            begin = total(parts, i + 1) + total(lengths, i)
            first = F.greatest(begin - 40, F.lit(0))
            near = F.lower(F.substring(whole, first + 1, begin + F.length(raw) + 20 - first))
            occasion = F.lit("unknown")
            for name, marks in reversed(OCCASIONS):
                occasion = F.when(near.rlike("|".join(rf"\Q{m}\E" for m in marks)), name).otherwise(occasion)
            y, m, d = (F.regexp_extract(raw, pattern, k).cast("int") for k in order)
            sound = m.between(1, 12) & d.between(1, 31) & y.between(1900, latest_year)
            return F.when(sound, F.struct(raw.alias("raw"), F.format_string("%04d-%02d-%02d", y, m, d).alias("date"), occasion.alias("occasion")))

        return let(F.struct(found.alias("f"), between.alias("b"), sizes.alias("s")), lambda x: F.array_compact(F.transform(x.f, lambda raw, i: one(raw, i, x.b, x.s))))

    return F.flatten(F.array(*(of(pattern, order, text(c)) for pattern, order in DATES)))


def distinguished_name(c: Column) -> Column:
    """X.500 text like CN=Ann Lee/O=Acme to a map of upper-case keys."""
    m = F.str_to_map(text(c), F.lit("[/,]"), F.lit("="))
    return F.transform_keys(m, lambda k, v: F.upper(F.trim(k)))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)))
