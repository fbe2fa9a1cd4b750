"""Correction rules: each is a Column that gives a contact's proposals as an
array; analyse() puts them together in a fixed order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..schemas import CHANGE, DELETE, DUPLICATE, INVALID
from .audit import contact_stats, rule_category

#: Pages of companies on a profile site, directories, and social sites.
COMPANY_PATHS = ["/company/", "/school/", "/showcase/", "/organization/"]
DIRECTORIES = ["glassdoor.com", "crunchbase.com", "zoominfo.com", "finstat.sk", "firmy.cz", "yelp.com"]
SOCIAL = ["facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com"]
GENERIC = ["info@", "office@", "support@", "admin@", "sales@", "contact@", "hello@", "noreply@", "no-reply@"]
#: Short company names and forms that keep their spelling.
ACRONYMS = ["IBM", "SAP", "HP", "DHL", "BMW", "IT", "EU", "SK", "CZ", "USA", "UK", "CEO", "CFO", "CTO", "COO", "HR", "PR", "QA"]
FORMS = {"s. r. o.": "s.r.o.", "s.r.o.": "s.r.o.", "sro": "s.r.o.", "a. s.": "a.s.", "a.s.": "a.s.", "k.s.": "k.s.", "v.o.s.": "v.o.s.", "spol.": "spol."}


def _changes(*items: Column) -> Column:
    """Proposals that apply (null ones don't)."""
    return F.array_compact(F.array(*items)).cast(f"array<{CHANGE}>")


def _change(when: Column, field: Column | str, old: Column, new: Column | str, confidence: Column | float, reason: Column | str, extra: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    s = F.struct(lit(field).alias("field"), T.text(old).alias("old"), T.text(lit(new)).alias("new"), lit(confidence).cast("double").alias("confidence"), lit(reason).alias("reason"), (F.lit(None) if extra is None else extra).cast("map<string,string>").alias("extra"))
    return F.when(F.coalesce(when, F.lit(False)), s)


def _each(items: Column, make) -> Column:
    """make(item, index) -> array of proposals, for all items in order."""
    return F.coalesce(F.flatten(F.transform(items, make)), F.array().cast(f"array<{CHANGE}>"))


def _at(array: str, i: Column, sub: str = "") -> Column:
    return F.concat(F.lit(f"{array}["), i.cast("string"), F.lit("]" + (f".{sub}" if sub else "")))


def phone(c: Column) -> Column:
    """struct(formatted, e164, kind, valid) by the rules of SK and CZ numbers:
    nine national digits, SK ones written with a leading 0; other international
    numbers are kept as they are when they have 8 to 15 digits."""

    def national(raw: Column) -> Column:
        d = F.regexp_replace(raw, r"\D", "")
        full = F.when(raw.startswith("+"), d).when(d.startswith("00"), F.substring(d, 3, 30)).when(d.rlike(r"^0[1-9]\d{8}$"), F.concat(F.lit("421"), F.substring(d, 2, 9))).when(d.rlike(r"^9\d{8}$"), F.concat(F.lit("421"), d)).when(d.rlike(r"^[2-7]\d{8}$"), F.concat(F.lit("420"), d)).otherwise(F.lit(""))
        return T.let(full, lambda f: described(raw, f, raw.startswith("+") | d.startswith("00")))

    def described(raw: Column, full: Column, international: Column) -> Column:
        home = full.rlike(r"^42[01]\d{9}$")
        valid = home | (international & full.rlike(r"^[1-9]\d{7,14}$") & ~full.rlike(r"^42[01]"))
        mobile = full.rlike(r"^4219") | full.rlike(r"^420[67]")
        grouped = F.regexp_replace(full, r"^(42[01])(\d{3})(\d{3})(\d{3})$", "+$1 $2 $3 $4")
        capital = F.regexp_replace(full, r"^4212(\d{3})(\d{3})(\d{2})$", "+421 2 $1 $2 $3")
        formatted = F.when(~valid, raw).when(full.rlike("^4212"), capital).when(home, grouped).otherwise(F.concat(F.lit("+"), full))
        return F.struct(formatted.alias("formatted"), F.when(valid, F.concat(F.lit("+"), full)).alias("e164"), F.when(~valid | ~home, "unknown").when(mobile, "mobile").otherwise("fixed_line").alias("kind"), valid.alias("valid"))

    return T.let(F.trim(T.text(c)), national)


def _seen_before(keys: Column, key: Column, i: Column) -> Column:
    return F.array_position(keys, key) < i + 1


def phone_rules() -> Column:
    """Format, missing type, and numbers the contact holds twice."""

    def rules(found: Column) -> Column:
        keys = F.transform(found, lambda n: F.regexp_replace(n.formatted, r"\D", ""))

        def make(p: Column, i: Column, keys: Column) -> Column:
            n = F.element_at(found, i + 1)
            return _changes(
                _change(n.valid & (n.formatted != p.value), _at("phoneNumbers", i, "value"), p.value, n.formatted, 0.95, "phone number normalization to international format"),
                _change((T.text(p.type) == "") & (n.kind != "unknown"), _at("phoneNumbers", i, "type"), F.lit(""), n.kind, 0.80, F.concat(F.lit("phone type detection ("), n.kind, F.lit(")"))),
                _change(_seen_before(keys, F.element_at(keys, i + 1), i), _at("phoneNumbers", i), p.value, DUPLICATE, 0.90, "duplicate phone number within contact"),
            )

        return T.let(keys, lambda ks: _each(F.col("phoneNumbers"), lambda p, i: make(p, i, ks)))

    return F.coalesce(T.let(F.transform("phoneNumbers", lambda p: phone(p.value)), rules), F.array().cast(f"array<{CHANGE}>"))


def email_rules(owner: list[str]) -> Column:
    """Spelling, validity, repeated addresses, and the owner's address elsewhere."""
    low = F.transform("emailAddresses", lambda e: F.lower(F.trim(T.text(e.value))))
    strangers = F.size(F.filter(low, lambda e: (e != "") & ~e.isin(owner))) > 0

    def rules(found: Column) -> Column:
        keys = F.transform(found, lambda n: n.value)

        def make(e: Column, i: Column, keys: Column) -> Column:
            n = F.element_at(found, i + 1)
            return _changes(
                _change(n.value != T.text(e.value), _at("emailAddresses", i, "value"), e.value, n.value, n.confidence, "email normalization (lowercase, trim)"),
                _change(~n.valid, _at("emailAddresses", i), e.value, INVALID, 0.70, "invalid email format"),
                _change(_seen_before(keys, n.value, i), _at("emailAddresses", i), e.value, DUPLICATE, 0.90, "duplicate email within contact"),
            )

        return T.let(keys, lambda ks: _each(F.col("emailAddresses"), lambda e, i: make(e, i, ks)))

    def misplaced(e: Column, i: Column) -> Column:
        v = F.lower(F.trim(T.text(e.value)))
        return _changes(_change(strangers & v.isin(owner), _at("emailAddresses", i), e.value, "", 0.95, F.concat(F.lit("owner email ("), v, F.lit(") incorrectly on non-owner contact"))))

    own = F.coalesce(T.let(F.transform("emailAddresses", lambda e: T.clean_email(e.value)), rules), F.array().cast(f"array<{CHANGE}>"))
    return F.concat(own, _each(F.col("emailAddresses"), misplaced)) if owner else own


def address_rules() -> Column:
    def make(a: Column, i: Column) -> Column:
        code = T.postal_code(T.text(a.postalCode))
        empty = lambda x: T.text(x) == ""
        place = ~empty(a.streetAddress) | ~empty(a.city)
        abroad = (code.country != "") & empty(a.country) & empty(a.countryCode) & place & ~empty(a.postalCode)
        whole = T.text(a.formattedValue)
        parse = ~place & whole.rlike(r"(?s)^[^,\n]+[,\n]\s*\d{3}\s?\d{2}\s+\S")
        part = lambda k: F.trim(F.regexp_extract(whole, r"(?s)^([^,\n]+)[,\n]\s*(\d{3}\s?\d{2})\s+([^,\n]+)", k))
        parsed = lambda sub, k, old: _change(parse & empty(old), _at("addresses", i, sub), F.lit(""), part(k), 0.60, "address parsed from formattedValue")
        return _changes(
            _change(~empty(a.postalCode) & (code.formatted != a.postalCode), _at("addresses", i, "postalCode"), a.postalCode, code.formatted, 0.95, "postal code formatting (XXX XX)"),
            _change(abroad, _at("addresses", i, "country"), F.lit(""), F.when(code.country == "SK", "Slovensko").otherwise("Česko"), 0.75, F.concat(F.lit("country inferred from postal code ("), code.country, F.lit(")"))),
            _change(abroad, _at("addresses", i, "countryCode"), F.lit(""), code.country, 0.75, "country code inferred from postal code"),
            parsed("streetAddress", 1, a.streetAddress),
            parsed("postalCode", 2, a.postalCode),
            parsed("city", 3, a.city),
        )

    return _each(F.col("addresses"), make)


def company_case(c: Column) -> Column:
    """Words capitalised; acronyms and short all-capital words stay; legal forms
    get their usual spelling, each once."""

    def word(w: Column) -> Column:
        x = F.regexp_replace(w, "[^a-zA-Z]", "")
        keep = F.upper(x).isin(ACRONYMS) | (F.length(x).between(2, 5) & (x == F.upper(x)))
        return F.when(keep, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))

    out = F.array_join(F.transform(F.filter(F.split(T.text(c), r"\s+"), lambda w: w != ""), word), " ")
    for form, proper in FORMS.items():
        out = T.let(out, lambda o: _once(o, form, proper))  # noqa: B023 (called at once)
    return out


def _once(c: Column, form: str, proper: str) -> Column:
    """The first occurrence of form, in any case, written as proper."""
    at = F.instr(F.lower(c), form)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(proper), F.substring(c, at + len(form), F.length(c)))).otherwise(c)


def title_of_job(c: Column) -> Column:
    word = lambda w: F.when(F.upper(F.regexp_replace(w, "[^a-zA-Z]", "")).isin(ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))
    return F.array_join(F.transform(F.split(T.text(c), r"\s+"), word), " ")


def organization_rules() -> Column:
    def make(o: Column, i: Column) -> Column:
        odd = lambda x: T.is_all_caps(x) | T.is_all_lower(x)
        site = T.text(o["name"]).rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$")
        name, title = company_case(o["name"]), title_of_job(o.title)
        return _changes(
            _change(odd(o["name"]) & ~site & (name != o["name"]), _at("organizations", i, "name"), o["name"], name, 0.70, "fix letter casing (organization)"),
            _change(odd(o.title) & (title != o.title), _at("organizations", i, "title"), o.title, title, 0.70, "fix letter casing (job title)"),
        )

    return _each(F.col("organizations"), make)


def org_matches(orgs: Column, base: Column) -> Column:
    """Whether an organisation is a domain's base name: equal without legal forms
    and blanks, or one whole word of it longer than two letters."""
    core = lambda o: F.trim(F.regexp_replace(F.regexp_replace(T.compare_key(o), r"\b(s\.?\s?r\.?\s?o|a\.?\s?s|k\.?\s?s|spol|gmbh|ltd|inc|corp|ag)\b\.?", ""), "[.,]", ""))
    return (F.length(base) >= 3) & F.exists(orgs, lambda o: (F.regexp_replace(core(o), "[^a-z0-9]", "") == base) | F.array_contains(F.split(core(o), r"[^a-z0-9]+"), base))


def url_rules() -> Column:
    orgs = F.filter(F.transform(F.coalesce("organizations", F.array().cast("array<struct<name:string,title:string>>")), lambda o: F.trim(T.text(o["name"]))), lambda o: o != "")

    def make(u: Column, i: Column) -> Column:
        value = F.trim(T.text(u.value))
        url = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
        path = F.lower(F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/+$", ""))
        return T.let(F.struct(value.alias("value"), T.url_host(url).alias("host"), path.alias("path")), lambda x: judge(x.value, x.host, x.path, i))

    def judge(value: Column, host: Column, path: Column, i: Column) -> Column:
        profile = host == "linkedin.com"
        page = profile & F.concat(path, F.lit("/")).rlike("^(" + "|".join(COMPANY_PATHS) + ")")
        slug = F.regexp_extract(path, r"^/([^/]+)", 1)
        base = lambda h: F.regexp_extract(h, r"([^.]+)\.[^.]+$", 1)
        mine, theirs = org_matches(orgs, base(host)), org_matches(orgs, slug)
        confidence = F.when(page, 0.95).when(profile, None).when(host.isin(DIRECTORIES), 0.90).when(host.isin(SOCIAL), F.when(theirs, 0.80)).when(mine & (path == ""), 0.85).when(mine, 0.65)
        reason = F.when(page, "corporate LinkedIn page (not a personal profile)").when(host.isin(DIRECTORIES), "corporate directory listing").when(host.isin(SOCIAL), "corporate social media page (matches organization name)").when(path == "", "corporate website homepage (matches organization)").otherwise("corporate website link (matches organization)")
        return _changes(_change((host != "") & confidence.isNotNull(), _at("urls", i), value, "", confidence, reason))

    return _each(F.col("urls"), make)


def note_rules() -> Column:
    """Phones, mail addresses and ids found in the first note, less what is there."""
    note = F.regexp_replace(T.text(F.try_element_at("biographies", F.lit(1)).value), r"(?s)── Last Interaction.*$", "")
    have = lambda array, f: F.transform(F.coalesce(F.col(array), F.array().cast("array<struct<value:string,type:string>>")), f)
    numbers = T.distinct_by(F.filter(F.transform(T.phones_in(note), phone), lambda p: F.length(T.digits(p.formatted)) >= 9), lambda p: T.digits(p.formatted))
    phones = F.filter(numbers, lambda p: ~F.array_contains(have("phoneNumbers", lambda x: T.digits(x.value)), T.digits(p.formatted)))
    mails = F.filter(F.array_distinct(F.transform(T.emails_in(note), lambda m: T.clean_email(m).value)), lambda m: ~F.array_contains(have("emailAddresses", lambda x: F.lower(T.text(x.value))), m) & T.clean_email(m).valid)
    ids = T.legal_ids(note)
    known = F.transform(F.coalesce("userDefined", F.array().cast("array<struct<key:string,value:string>>")), lambda u: u.value)
    own = lambda v, key, what: _change(v.isNotNull() & ~F.array_contains(known, v), "userDefined[+]", F.lit(""), v, 0.92, f"{what} found in notes", F.create_map(F.lit("key"), F.lit(key), F.lit("value"), v))
    return F.concat(
        _each(phones, lambda p: _changes(_change(F.lit(True), "phoneNumbers[+]", F.lit(""), p.formatted, 0.70, "phone number found in notes", F.create_map(F.lit("type"), F.when(p.kind == "unknown", "other").otherwise(p.kind))))),
        _each(mails, lambda m: _changes(_change(F.lit(True), "emailAddresses[+]", F.lit(""), m, 0.70, "email found in notes", F.create_map(F.lit("type"), F.lit("other"))))),
        _changes(own(ids.company_id, "IČO", "company ID"), own(ids.tax_id, "DIČ", "tax ID"), own(ids.vat_id, "IČ DPH", "VAT ID")),
    )


def mail_rules(free: list[str] = T.FREE_DOMAINS) -> Column:
    """Name and organisation from the first fitting mail address, where missing."""
    first = lambda f: F.try_element_at(F.filter(F.transform("emailAddresses", f), lambda x: x.isNotNull()), F.lit(1))
    name = F.try_element_at("names", F.lit(1))
    nameless = (T.text(name.givenName) == "") & (T.text(name.familyName) == "")
    found, company = first(lambda e: T.name_from_email(e.value)), first(lambda e: T.company_domain(e.value, free))
    no_org = F.coalesce(F.size("organizations") <= 0, F.lit(True))
    label = F.initcap(F.element_at(F.split(company, r"\."), 1))
    return _changes(
        _change(nameless & found.isNotNull(), "names[0].givenName", F.lit(""), found.given, 0.55, "name inferred from email"),
        _change(nameless & found.isNotNull(), "names[0].familyName", F.lit(""), found.family, 0.55, "name inferred from email"),
        _change(no_org & company.isNotNull(), "organizations[+].name", F.lit(""), label, 0.50, "organization inferred from email domain"),
    )


def cross_field_rules() -> Column:
    """Given and family name from the display name, where both are missing."""
    n = F.try_element_at("names", F.lit(1))
    missing = (T.text(n.givenName) == "") & (T.text(n.familyName) == "") & F.trim(T.text(n.displayName)).rlike(r"^\S+\s+\S+")
    words = F.split(F.trim(T.text(n.displayName)), r"\s+")
    return _changes(
        _change(missing, "names[0].givenName", F.lit(""), words[0], 0.80, "name extracted from display name"),
        _change(missing, "names[0].familyName", F.lit(""), F.array_join(F.slice(words, F.lit(2), F.size(words)), " "), 0.80, "name extracted from display name"),
    )


def deletion_rule(free: list[str] = T.FREE_DOMAINS) -> Column:
    """Contacts with next to nothing in them."""
    n = F.try_element_at("names", F.lit(1))
    some = lambda array: F.coalesce(F.size(array) > 0, F.lit(False))
    full = (F.trim(T.text(n.givenName)) != "") & (F.trim(T.text(n.familyName)) != "")
    private = F.coalesce(F.exists("emailAddresses", lambda e: T.email_domain(e.value).isin(free)), F.lit(False))
    titled = F.coalesce(F.exists("organizations", lambda o: T.text(o.title) != ""), F.lit(False))
    noted = F.coalesce(F.exists("biographies", lambda b: F.trim(T.text(b.value)) != ""), F.lit(False))
    points = sum((F.when(c, w).otherwise(0.0) for c, w in ((full, 1.0), (private, 1.0), (~private & some("emailAddresses"), 0.5), (some("phoneNumbers"), 1.0), (some("addresses"), 1.0), (some("birthdays"), 0.5), (titled, 0.5), (noted, 0.5))), F.lit(0.0))
    lacks = F.concat_ws(", ", F.when(~full, "no full name"), F.when(~some("emailAddresses"), "no email"), F.when(~some("phoneNumbers"), "no phone"), F.when(~some("addresses"), "no address"))
    return _changes(_change(points <= 1, "contact", T.display_name(F.col("names")), DELETE, F.when(points <= 0.5, 0.55).otherwise(0.45), F.concat(F.lit("low-value contact deletion candidate ("), lacks, F.lit(")"))))


def name_rules(learned: dict[str, str] | None = None) -> Column:
    """The stateful name rules, over Arrow batches."""
    known = dict(learned or {})

    @F.pandas_udf(f"array<{CHANGE}>")
    def run(first: pd.DataFrame, orgs: pd.Series) -> pd.Series:
        rows = first.to_dict("records")
        blank = lambda r: {k: v for k, v in r.items() if isinstance(v, str)}
        return pd.Series([[c | {"extra": None} for c in N.propose(blank(r), [o for o in (os if os is not None else []) if o], known)] for r, os in zip(rows, orgs)])

    return run(F.coalesce(F.try_element_at("names", F.lit(1)), F.from_json(F.lit("{}"), "displayName string, givenName string, familyName string, middleName string, unstructuredName string, honorificPrefix string, honorificSuffix string")), F.transform("organizations", lambda o: o["name"]))


def date_rules(latest_year: int) -> Column:
    """Birthdays and other days found in the first note, where the contact has none."""
    note = F.split(T.text(F.try_element_at("biographies", F.lit(1)).value), r"\Q── Last Interaction\E")[0]
    none = lambda array: F.coalesce(F.size(array) <= 0, F.lit(True))

    def make(d: Column) -> Column:
        born, day = d.occasion == "birthday", d.occasion.isin("nameday", "anniversary")
        return _changes(
            _change(born & none("birthdays"), "birthdays[+]", F.lit(""), d.date, 0.60, F.concat(F.lit("birthday extracted from notes ("), d.raw, F.lit(")"))),
            _change(day & none("events"), "events[+]", F.lit(""), d.date, 0.55, F.concat(F.lit("event extracted from notes ("), d.occasion, F.lit(": "), d.raw, F.lit(")")), F.create_map(F.lit("type"), d.occasion)),
        )

    return _each(T.dates_in(note, latest_year), make)


def shared_address_rule(contacts: DataFrame, least: int = 3) -> DataFrame:
    """Addresses that several contacts have: proposals to remove them, surer the
    more contacts there are -> (resourceName, change)."""
    each = contacts.select("resourceName", F.posexplode("addresses").alias("i", "a"))
    keyed = each.withColumn("key", T.address_key(F.col("a.streetAddress"), F.col("a.city"), F.col("a.postalCode"), F.col("a.formattedValue"))).where("key <> ''")
    shared = keyed.groupBy("key").agg(F.countDistinct("resourceName").alias("n")).where(F.col("n") >= least)
    sure = F.when(F.col("n") >= 10, 0.90).when(F.col("n") >= 5, 0.80).otherwise(0.70)
    made = _change(F.lit(True), _at("addresses", F.col("i")), T.text(F.coalesce("a.formattedValue", "key")), "", sure, F.concat(F.lit("shared office address ("), F.col("n").cast("string"), F.lit(" contacts)")))
    return keyed.join(shared, "key").select("resourceName", made.cast(CHANGE).alias("change"))


def analyse(contacts: DataFrame, owner: list[str] | None = None, learned: dict[str, str] | None = None, latest_year: int = 2100) -> DataFrame:
    """All proposals, one row each: resource_name, seq, field, old, new,
    confidence, reason, extra, category, actionable. No-ops and empty values
    (but where empty means removal) go; sentinels are information only."""
    rules = F.concat(name_rules(learned), phone_rules(), email_rules(owner or []), address_rules(), organization_rules(), url_rules(), note_rules(), date_rules(latest_year), mail_rules(), cross_field_rules(), deletion_rule())
    own = contacts.select("resourceName", F.posexplode(rules).alias("seq", "change"))
    shared = shared_address_rule(contacts).select("resourceName", F.lit(10_000).alias("seq"), "change")
    rows = own.unionByName(shared).select(F.col("resourceName").alias("resource_name"), "seq", "change.*")
    removal = F.col("field").rlike(r"middleName$|^urls\[|^emailAddresses\[|^addresses\[|givenName$")
    real = ~F.col("old").eqNullSafe(F.col("new")) & ((F.col("new") != "") | removal)
    return rows.where(real).withColumns({"category": rule_category(F.col("reason")), "actionable": ~F.col("new").isin(DUPLICATE, INVALID, DELETE)})


def with_stats(changes: DataFrame) -> DataFrame:
    """Contacts with findings: their counts by band and their changes in order."""
    listed = changes.groupBy("resource_name").agg(F.array_sort(F.collect_list(F.struct("seq", "field", "old", "new", "confidence", "reason"))).alias("changes"))
    return contact_stats(changes).join(listed, "resource_name")


def is_generic(c: Column, prefixes: list[str] = GENERIC, exact: list[str] | None = None) -> Column:
    low = F.lower(T.text(c))
    return low.isin(exact or []) | F.concat(F.element_at(F.split(low, "@"), 1), F.lit("@")).isin(prefixes)


def external_match_rules(matches: DataFrame) -> DataFrame:
    """matches (resource_name, route: email, company or name, org, title, url,
    known_orgs, known_urls arrays) -> proposals of what is not there yet."""
    sure = F.when(F.col("route") == "email", 0.95).when(F.col("route") == "company", 0.85).otherwise(0.70)
    low = lambda a: F.transform(F.coalesce(F.col(a), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    made = _changes(
        _change((T.text("org") != "") & ~F.array_contains(low("known_orgs"), F.lower(F.trim("org"))), "organizations[+].name", F.lit(""), F.col("org"), sure, "organization from external list", F.create_map(F.lit("title"), T.text("title"))),
        _change((T.text("url") != "") & ~F.array_contains(low("known_urls"), F.lower(F.trim("url"))), "urls[+].value", F.lit(""), F.col("url"), sure, "profile from external list"),
    )
    return matches.select("resource_name", F.posexplode(made).alias("seq", "change")).select("resource_name", "seq", "change.*")
