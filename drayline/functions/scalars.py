"""Rules on single values as column expressions: dates, phones, identifiers, names, money, addresses, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: How legal forms are written out.
LEGAL_FORMS = {
    "llc": "LLC", "inc": "Inc", "incorporated": "Inc", "corp": "Corp", "corporation": "Corp", "co": "Co", "company": "Co", "ltd": "Ltd", "limited": "Ltd",
}
#: Street kinds and their short forms.
STREET_FORMS = {"STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN"}
#: Weights of name, phone, address and email in the similarity of two customers.
WEIGHTS = {"name": 0.31, "phone": 0.25, "address": 0.34, "email": 0.10}


def clean(text: Column) -> Column:
    """Without white space at the ends, and with single blanks inside."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def normalize_date(text: Column) -> Column:
    """Struct ``(iso, ambiguous, note)`` of a calendar date in one of three notations; null stays ``empty``.

    Year-first, day-month-year with month names, and month/day/year with four digits are read; month/day/year with two
    digits is ambiguous; everything else is an unrecognised, ambiguous format.
    """
    v = F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    named = r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4}|[0-9]{2})$"
    slashed = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(v, named, 2)))
    short = F.regexp_extract(v, named, 3)
    year = F.when(F.length(short) == 4, short).otherwise(F.concat(F.when(short >= "70", "19").otherwise("20"), short))

    def day(y: Column, m: Column, d: Column) -> Column:
        text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        year, number, last = (F.nullif(x, F.lit("")).cast("int") for x in (y, m, d))
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        late = F.when(number == 2, (last == 29) & leap).otherwise((last <= 30) | ((last == 31) & number.isin(1, 3, 5, 7, 8, 10, 12)))
        return F.when((year >= 1) & number.between(1, 12) & (last >= 1) & ((last <= 28) | late), text)

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(v, pattern, k)

    value = (
        F.when(v.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(v.rlike(named) & (month > 0), day(year, month.cast("string"), part(named, 1)))
        .when(v.rlike(slashed), day(part(slashed, 3), part(slashed, 1), part(slashed, 2)))
    )
    shape = (
        F.when(v == "", "empty")
        .when(v.rlike(iso) | v.rlike(slashed), "date")
        .when(v.rlike(named), F.when(month > 0, "date").otherwise("invalid month name"))
        .when(v.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), "ambiguous 2-digit year")
        .otherwise("unrecognized format")
    )
    return F.struct(
        value.alias("iso"),
        shape.isin("ambiguous 2-digit year", "unrecognized format").alias("ambiguous"),
        F.when(shape != "date", shape).when(value.isNull(), "invalid date").alias("note"),
    )


def normalize_phone(text: Column) -> Column:
    """``+1`` and ten digits of a valid North American number, else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    ten = F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "")
    return F.when(ten.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}[0-9]{4}$"), F.concat(F.lit("+1"), ten))


def normalize_container_id(text: Column) -> Column:
    """``RC-`` and the number without leading zeros; what has no such number is only cleaned and put in capitals."""
    v = F.upper(clean(text))
    digits = F.regexp_extract(v, "^(?:RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?([0-9]{1,6})$", 1)
    return F.when(digits != "", F.concat(F.lit("RC-"), F.regexp_replace(digits, "^0+(?=[0-9])", ""))).otherwise(v)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def normalize_company_name(text: Column) -> Column:
    """Capital at each word and after each hyphen; a legal form at the end in one spelling.

    Commas and points before a legal form go, without one they stay.
    """
    v = clean(text)
    words = F.split(v, " ")
    form = _lookup(LEGAL_FORMS, F.lower(F.regexp_replace(F.element_at(words, -1), r"^,|\.", "")))
    before = F.regexp_replace(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), "[,.]+$", "")

    def capital(w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "-")

    def title(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, " "), capital), " ")

    return F.when(v == "", "").when(form.isNull(), title(v)).otherwise(F.concat_ws(" ", F.nullif(title(before), F.lit("")), form))


def cents_of(text: Column) -> Column:
    """Integer cents of an amount with optional sign, currency mark and separators; null where it is no amount."""
    v = F.regexp_replace(text, r"[$,\s]", "")
    pattern = r"^(-?)([0-9]{1,15})(?:\.([0-9]{1,2}))?$"
    # guarded, as a failed cast is an exception, which takes longer than all the rest
    units = F.nullif(F.regexp_extract(v, pattern, 2), F.lit("")).cast("long")
    part = F.rpad(F.regexp_extract(v, pattern, 3), 2, "0").cast("long")
    amount = units * 100 + part
    return F.when(F.regexp_extract(v, pattern, 1) == "-", -amount).otherwise(amount)


def display_cents(cents: Column) -> Column:
    """``-$1,234.05``."""
    whole, part = F.floor(F.abs(cents) / 100), F.abs(cents) % 100
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), F.format_number(whole, 0), F.lit("."), F.lpad(part.cast("string"), 2, "0"))


def strip_legal_forms(text: Column) -> Column:
    return clean(F.regexp_replace(text, r"(?i)\b(?:LLC|INC|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED)\b\.?", ""))


def phonetic_key(name: Column) -> Column:
    """First letter of the name, and its first three characters that are neither vowels nor blanks."""
    v = F.upper(strip_legal_forms(name))
    return F.concat(F.substring(v, 1, 1), F.substring(F.regexp_replace(v, r"[AEIOUY\s]", ""), 1, 3))


def normalize_address(text: Column) -> Column:
    v = F.upper(clean(text))
    for long, short in STREET_FORMS.items():
        v = F.regexp_replace(v, rf"\b{long}\b", short)
    return v


def blocking_key(name: Column, phone: Column, address: Column | None = None) -> Column:
    """Key of name and phone, each empty where there is nothing; with an address, that is a third part."""
    parts = [phonetic_key(name), normalize_phone(phone)] + ([] if address is None else [normalize_address(address)])
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the words of two texts."""

    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.upper(clean(x)), " "), lambda w: w != ""))

    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def comparable(name: Column, phone: Column, address: Column, email: Column) -> Column:
    """Struct of a customer's fields in the form in which they are compared; empty where there is nothing."""

    def text(x: Column) -> Column:
        return F.coalesce(x, F.lit(""))

    return F.struct(
        F.upper(normalize_company_name(text(name))).alias("name"),
        text(normalize_phone(phone)).alias("phone"),
        normalize_address(text(address)).alias("address"),
        F.lower(F.regexp_replace(text(email), r"(?U)^\s+|\s+$", "")).alias("email"),
    )


def customer_similarity(a: str, b: str) -> Column:
    """Weighted similarity of two customers, given as columns that :func:`comparable` made.

    Names are compared by edits, addresses by their words; two empty addresses are alike. The weight of the email counts
    even where one has none. The same phone with the same words in the address are at least 0.9.
    """

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"{a}.{name}"), F.col(f"{b}.{name}")

    def same(name: str) -> Column:
        x, y = both(name)
        return ((x != "") & (x == y)).cast("double")

    address = jaccard(*both("address"))
    parts = {"name": similarity(*both("name")), "phone": same("phone"), "address": address, "email": same("email")}
    weighted = sum((parts[k] * w for k, w in WEIGHTS.items()), start=F.lit(0.0)) / sum(WEIGHTS.values())
    return F.round(F.when((same("phone") == 1.0) & (address == 1.0), F.greatest(weighted, F.lit(0.9))).otherwise(weighted), 6)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-16 units, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(F.transform(codes, lambda c: F.when(c > 65535, F.array(F.floor((c - 65536) / 1024) + 55296, (c - 65536) % 1024 + 56320)).otherwise(F.array(c))))
    value = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def infer_entity_type(fields: dict[str, Column]) -> Column:
    """Kind of a record from which of its fields hold something; the first rule that fits decides."""

    def has(name: str) -> Column:
        return F.coalesce(F.trim(fields[name]) != "", F.lit(False)) if name in fields else F.lit(False)

    name = fields.get("name", F.lit(None).cast("string"))
    return (
        F.when(has("grossTons") & has("date"), "ticket")
        .when(has("serviceCode") | has("rateCents") | (has("startDate") & has("status")), "agreement")
        .when(F.coalesce(name.startswith("Container "), F.lit(False)), "container")
        .when(F.coalesce(name.startswith("Route "), F.lit(False)), "route")
        .when(has("phone") & has("name"), "customer")
        .when(has("sizeYards") | has("type"), "container")
        .when(has("name") & has("address") & ~has("serviceCode") & ~has("dayOfWeek"), "site")
        .when(has("dayOfWeek") | (has("name") & has("siteIds")), "route")
        .otherwise("unknown")
    )


def histogram_bucket(confidence: Column) -> Column:
    """Tenth of the unit interval, 0 to 9; 1.0 belongs to the last."""
    return F.least(F.lit(9), F.floor(confidence * 10)).cast("int")


def multiply_cents(cents: Column, rate: Column) -> Column:
    """Cents times a rate, halves rounded up."""
    return F.floor(cents * rate + 0.5).cast("long")


def shown_cents(text: Column) -> Column:
    """Cents given as text, as an amount; what is no number stays as it is, nothing stays empty."""
    cents = text.try_cast("double")
    amount = F.concat(F.lit("$"), F.format_number(F.floor(cents + 0.5).cast("decimal(30,0)") / 100, 2))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(cents.isNull(), text).otherwise(amount)


def percent(value: Column) -> Column:
    """One decimal, as in ``12.5%``."""
    return F.concat(F.format_string("%.1f", value * 100), F.lit("%"))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)


#: What the types of exceptions are called.
EXCEPTION_LABELS = {
    "entity_resolution": "Possible duplicate",
    "missing_service_code": "No service code on file",
    "low_mapping_confidence": "Uncertain service code mapping",
    "pricing_conflict": "Conflicting pricing",
    "orphan_container": "No site assigned",
    "missing_customer_reference": "Not linked to a customer yet",
    "missing_site_reference": "Not linked to a site yet",
    "closed_but_unbilled": "Closed but not fully billed",
    "unmatched_scale_ticket": "Not linked to a job",
    "ungeocodable_site": "Address needs verification",
}


def exception_label(kind: Column) -> Column:
    """What a type is called; without a name of its own, the type with blanks."""
    return F.coalesce(_lookup(EXCEPTION_LABELS, kind), F.replace(kind, F.lit("_"), F.lit(" ")))


def first_address(forwarded: Column, real: Column) -> Column:
    """Where a request came from: the first forwarded address, without any the real one, else ``unknown``."""
    return F.when(F.coalesce(forwarded, F.lit("")) != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(F.coalesce(real, F.lit("unknown")))


def location_text(city: Column, state: Column, zip_code: Column) -> Column:
    """What there is of town, state and zip, with commas between."""
    return F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in (city, state, zip_code)])


def mapped_text(lob: Column, size_yards: Column) -> Column:
    """Line of business with its size, as in ``rolloff (20yd)``."""
    size = F.when(size_yards.isNotNull(), F.concat(F.lit(" ("), size_yards.cast("string"), F.lit("yd)"))).otherwise("")
    return F.when(F.coalesce(lob, F.lit("")) != "", F.concat(lob, size)).otherwise("Not mapped")
