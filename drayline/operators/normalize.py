"""Records with normalised fields, and a flag for every value that couldn't be normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.functions.scalars import cents_of, infer_entity_type, normalize_company_name, normalize_container_id, normalize_date, normalize_phone

#: Which fields are dates, identifiers of containers, and amounts.
DATES = ("date", "startDate", "endDate", "signedDate")
#: Fixed value: what a record's own identifier looks like if it is one of a container.
LIKE_CONTAINER = r"(?i)^(?:RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?[0-9]{1,6}$"
AMOUNTS = ("rateCents", "amount", "price")


def normalize_fields(fields: dict[str, Column], read: dict[str, Column] | None = None) -> tuple[dict[str, Column], Column]:
    """Normalised fields, and an array of ``(field, note)`` in the order name, phone, dates, identifiers, amounts.

    A phone, date or amount that can't be normalised stays as it was and gets a flag, an identifier that isn't one of a
    container only the flag. Fields that no rule knows pass through; null and blank values get no flag. ``read`` has the
    results of ``normalize_date`` that stand in columns already.
    """
    out, flags = dict(fields), []

    def given(x: Column) -> Column:
        return F.coalesce(F.trim(x) != "", F.lit(False))

    def flag(name: str, bad: Column, note: Column | str) -> None:
        flags.append(F.when(bad, F.struct(F.lit(name).alias("field"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))))

    if "name" in fields:
        out["name"] = F.when(given(fields["name"]), normalize_company_name(fields["name"])).otherwise(fields["name"])
    if "phone" in fields:
        phone = normalize_phone(fields["phone"])
        out["phone"] = F.coalesce(phone, fields["phone"])
        flag("phone", given(fields["phone"]) & phone.isNull(), "not E.164")
    for name in DATES:
        if name in fields:
            d = (read or {}).get(name, normalize_date(fields[name]))
            out[name] = F.coalesce(d["iso"], fields[name])
            flag(name, given(fields[name]) & d["note"].isNotNull(), d["note"])
    if "containerId" in fields:
        out["containerId"] = F.when(given(fields["containerId"]), normalize_container_id(fields["containerId"])).otherwise(fields["containerId"])
        flag("containerId", given(fields["containerId"]) & ~out["containerId"].rlike("^RC-[0-9]+$"), "unrecognized container id")
    if "id" in fields:
        out["id"] = F.when(F.trim(fields["id"]).rlike(LIKE_CONTAINER), normalize_container_id(fields["id"])).otherwise(fields["id"])
    for name in AMOUNTS:
        if name in fields:
            cents = cents_of(fields[name])
            out[name] = F.coalesce(cents.cast("string"), fields[name])
            flag(name, given(fields[name]) & cents.isNull(), "invalid money")
    return out, F.filter(F.array(*flags), lambda f: f.isNotNull()) if flags else F.array().cast("array<struct<field:string,note:string>>")


def normalize_records(records: DataFrame, record_id: str, columns: dict[str, str]) -> DataFrame:
    """``(record_id, <fields>, entity_type, flags)``; ``columns`` gives the column of each field."""
    texts = {field: F.col(column).cast("string") for field, column in columns.items()}
    days = {field: normalize_date(texts[field]).alias(f"_{field}_read") for field in DATES if field in texts}
    # dates are read in a step of their own, so that no rule is repeated in the code of another
    held = records.select(F.col(record_id).alias("record_id"), *[x.alias(f"_{f}") for f, x in texts.items()], *days.values())
    fields, flags = normalize_fields({f: F.col(f"_{f}") for f in texts}, {f: F.col(f"_{f}_read") for f in days})
    done = held.select("record_id", *[x.alias(f) for f, x in fields.items()], flags.alias("flags"))
    return done.select("record_id", *fields, infer_entity_type({f: F.col(f) for f in fields}).alias("entity_type"), "flags")


def flag_rows(normalized: DataFrame) -> DataFrame:
    """One row for every flag, with its place among the record's flags."""
    return normalized.select("record_id", F.posexplode("flags").alias("position", "f")).select("record_id", "position", "f.field", "f.note")
