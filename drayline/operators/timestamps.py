"""Timestamps in many notations and zones as unambiguous UTC instants.

Every value is read once under each notation that can stand for it. Values with one valid reading teach, per source, how
likely each notation is (expectation-maximisation over the source's mixture of notations); the posterior then decides
values with several valid readings, and what stays undecided is marked so. An order that a source declares is a prior of
the weight of ``DECLARED`` values, no more. All parsing and zone arithmetic are JVM
expressions; only the counts of reading sets, of which a source has few, reach Python.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize
from drayline.plans.skew import fenced, salted_join

#: The notations whose readings compete for the same text, in the order of the bits of a reading set.
NOTATIONS = ("named", "ymd", "mdy", "dmy", "compact", "serial", "seconds", "millis", "micros")
MAX_SOURCES = 10_000
#: Weight of the notation that a source declares, and of any other, in pseudo-values.
DECLARED, UNDECLARED = 1000.0, 1.0
MIN_POSTERIOR = 0.95
EM_ROUNDS = 60
DAY = 86_400_000_000

_BLANKS = r"(?U)^\s+|\s+$"
#: A date's parts: year first, day or month first, eight digits, month name second, month name first.
_DATE = (
    r"(?:([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})|([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})|([0-9]{8})"
    r"|([0-9]{1,2})[- ]([A-Za-z]{3,9})\.?,?[- ]([0-9]{4}|[0-9]{2})|([A-Za-z]{3,9})\.? ([0-9]{1,2}),? ([0-9]{4}))"
)
_TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(Z|z|[+-][0-9]{2}(?::?[0-9]{2})?|[A-Z]{3,5}|\[?[A-Za-z_]+(?:/[A-Za-z_+-]+)+\]?)"
_WHOLE = rf"^(?:[A-Za-z]{{3,9}},\s*)?{_DATE}(?:(?:[Tt]|\s+){_TIME}(?:\s*{_ZONE})?)?$"
_PARTS = ("y1", "m1", "d1", "a2", "b2", "y2", "whole", "d3", "n3", "y3", "n4", "d4", "y4", "hh", "mm", "ss", "frac", "half", "zone")

_NUMBERS = ("y1", "m1", "d1", "a2", "b2", "y2", "whole", "d3", "y3", "d4", "y4", "hh", "mm", "ss")
#: Abbreviations that mean the same everywhere, with their offsets in minutes.
UNIVERSAL = {"UTC": 0, "GMT": 0}
#: Years in which a zone's own abbreviations are looked up.
FIRST_YEAR, LAST_YEAR = 1970, 2037
#: Month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _int(text: Column) -> Column:
    """Number of digits; null for an empty text, as a failed cast is an exception, which takes longer than all the rest."""
    return F.when(text != "", text.cast("int"))


def _is_zone(name: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), name)).isNotNull()


def to_instant(local: Column, zone: Column) -> Column:
    """UTC microseconds of local microseconds in a zone: the only instant shown so, null if there is none or are two."""

    def shown(instant: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone))

    before, after = local - F.lit(DAY), local + F.lit(DAY)
    # the offsets in force a day earlier and a day later cover both sides of any change between them
    first, second = local - (shown(before) - before), local - (shown(after) - after)
    first_fits, second_fits = shown(first) == local, shown(second) == local
    return F.when(first_fits & second_fits & (first != second), None).when(first_fits, first).when(second_fits, second)


def zone_abbreviations(zone: str | None) -> dict[str, int]:
    """Abbreviations that a zone's own rules use, with their offsets in minutes; the latest use counts. Unknown zones have none."""
    try:
        rules = ZoneInfo(zone or "")
    except Exception:  # noqa: BLE001 -- whatever a table calls a zone, it has no abbreviations then
        return dict(UNIVERSAL)
    found = dict(UNIVERSAL)
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        for month in range(1, 13):
            at = dt.datetime(year, month, 1, 12, tzinfo=rules)
            found[at.tzname() or ""] = round((at.utcoffset() or dt.timedelta()).total_seconds() / 60)
    return found


def _abbreviations(zones: pd.Series) -> pd.Series:
    return pd.Series([zone_abbreviations(z) for z in zones])


def _day(year: Column, month: Column, day: Column) -> Column:
    """Microseconds of a calendar day, as if it were UTC; null if the calendar lacks it."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    # checked by hand, as a failed try is an exception, which takes longer than all the rest
    late = F.when(month == 2, (day == 29) & leap).otherwise((day <= 30) | ((day == 31) & month.isin(1, 3, 5, 7, 8, 10, 12)))
    there = (year >= 1) & month.between(1, 12) & (day >= 1) & ((day <= 28) | late)
    return F.when(there, F.unix_date(F.make_date(year, month, day)).cast("long") * F.lit(DAY))


def readings(values: DataFrame, zone_col: str = "time_zone", names_col: str = "abbreviations") -> DataFrame:
    """Adds the array ``_readings``: by notation the day, or for numbers the time, in microseconds; null where impossible.

    Also ``set``, the bits of the notations under which the text is a possible date, whether or not one instant follows,
    and the parts that all notations share: ``_time`` of day, ``_offset`` in minutes and the zone's ``_name``. One match takes a
    text apart; everything after it works on its short parts.
    """
    df = values.withColumn("_v", F.regexp_replace("value", _BLANKS, ""))
    # parts of a text begin with an empty one; a text that doesn't match stays one part, and all others are null
    cut = "".join(f"\x1f${k}" for k in range(1, len(_PARTS) + 1))
    df = df.withColumn("_p", F.split(F.regexp_replace("_v", _WHOLE, cut), "\x1f"))
    at = {name: k for k, name in enumerate(_PARTS, 1)}
    df = df.withColumn("_n", F.array(*[_int(F.get("_p", F.lit(at[name]))) for name in _NUMBERS]))
    odd = F.size("_p") == 1

    def text(name: str) -> Column:
        return F.get("_p", F.lit(at[name]))

    def n(name: str) -> Column:
        return F.col("_n")[_NUMBERS.index(name)]

    def full(name: str) -> Column:
        return n(name) + F.when(F.length(text(name)) == 2, 2000).otherwise(0)

    half, hh = F.upper(text("half")), n("hh")
    hour = F.when(half == "", hh).when(hh.between(1, 12), hh % 12 + F.when(half == "P", 12).otherwise(0))
    month = _lookup({m: i + 1 for i, m in enumerate(MONTHS)}, F.lower(F.substring(F.concat(text("n3"), text("n4")), 1, 3)))
    df = df.withColumns({"_hour": hour, "_second": F.coalesce(n("ss"), F.lit(0)), "_y2": full("y2"), "_y3": full("y3"), "_month": month, "_zone": F.coalesce(text("zone"), F.lit(""))})
    zone = F.col("_zone")
    fraction = F.when(text("frac") == "", 0).otherwise(_int(F.substring(F.rpad(text("frac"), 6, "0"), 1, 6)))
    time = F.when(hh.isNull(), F.lit(0).cast("long")).when(
        F.col("_hour").between(0, 23) & n("mm").between(0, 59) & F.col("_second").between(0, 59), ((F.col("_hour") * 60 + n("mm")).cast("long") * 60 + F.col("_second")) * 1_000_000 + fraction
    )
    digits = F.regexp_replace(zone, "[^0-9]", "")
    signed = (_int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    first = F.substring(zone, 1, 1)
    offset = F.when(zone == "", None).when(zone.isin("Z", "z"), 0).when(first.isin("+", "-"), signed).when(~zone.contains("/"), F.try_element_at(F.col(names_col), zone))
    named = F.when(zone == "", F.col(zone_col)).when(zone.contains("/"), F.regexp_replace(zone, r"[\[\]]", ""))
    v = F.col("_v")

    def number(pattern: str, scale: int) -> Column:
        return F.when(odd & v.rlike(pattern), v.try_cast("long") * F.lit(scale))

    plain = F.when(odd & v.rlike(r"^[0-9]{5}(?:[.][0-9]{1,10})?$"), v.try_cast("decimal(16,10)"))
    eight = n("whole")
    local = {
        "named": F.coalesce(_day(F.col("_y3"), F.col("_month"), n("d3")), _day(n("y4"), F.col("_month"), n("d4"))),
        "ymd": _day(n("y1"), n("m1"), n("d1")),
        "mdy": _day(F.col("_y2"), n("a2"), n("b2")),
        "dmy": _day(F.col("_y2"), n("b2"), n("a2")),
        "compact": _day(F.floor(eight / 10_000).cast("int"), F.floor(eight / 100).cast("int") % 100, eight % 100),
        # day 60 of the 1900 system never was; days after it count from 1899-12-30
        "serial": F.when((plain >= 61) & (plain < 73051), F.round((plain - 25569) * DAY, 0).cast("long")),
        "seconds": number("^[0-9]{9,10}$", 1_000_000), "millis": number("^[0-9]{12,13}$", 1_000), "micros": number("^[0-9]{15,16}$", 1),
    }
    df = df.withColumns({"_time": F.when(odd, F.lit(0).cast("long")).otherwise(time), "_offset": offset.cast("long"), "_name": named, "_readings": F.array(*[local[k] for k in NOTATIONS])})
    # the sources' own zones were checked once; only names in the text itself are checked here
    df = df.withColumn("_known", F.when(zone.contains("/"), _is_zone(F.col("_name"))).otherwise(F.col("_name").isNotNull()))
    bits = F.lit(0)
    for k in range(len(NOTATIONS)):
        bits = bits + F.when(F.col("_readings")[k].isNotNull(), 1 << k).otherwise(0)
    df = df.withColumn("set", F.when(F.col("_time").isNull(), 0).otherwise(bits))
    return df.drop("_v", "_p", "_n", "_zone", "_month", "_hour", "_second", "_y2", "_y3")


def fit_notations(counts: pd.DataFrame, declared: str | None) -> np.ndarray:
    """Mixture weights of one source's notations from its counts of reading sets, by expectation-maximisation."""
    sets, n = counts["set"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    can = (sets[:, None] >> np.arange(len(NOTATIONS))) & 1
    prior = np.full(len(NOTATIONS), UNDECLARED)
    if declared in NOTATIONS:
        prior[NOTATIONS.index(declared)] = DECLARED
    weight = prior / prior.sum()
    for _ in range(EM_ROUNDS):
        joint = can * weight
        posterior = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        fresh = prior + (posterior * n[:, None]).sum(0)
        fresh /= fresh.sum()
        done, weight = np.abs(fresh - weight).max() < 1e-12, fresh
        if done:
            break
    return weight


def _systems(systems: DataFrame) -> DataFrame:
    """``source``, ``time_zone``, ``date_order`` and the zone's ``abbreviations``, one row per source."""
    known = systems.where("kind is not null").groupBy(F.col("kind").alias("source")).agg(F.min("time_zone").alias("time_zone"), F.min(F.lower("date_order")).alias("date_order"))
    known = known.withColumn("time_zone", F.when(_is_zone(F.col("time_zone")), F.col("time_zone")))
    return materialize(known.withColumn("abbreviations", F.pandas_udf(_abbreviations, "map<string,int>")("time_zone")))


def source_weights(read: DataFrame) -> DataFrame:
    """``(source, weights)``: the mixture of notations of each source, from how often it shows each set of readings.

    ``read`` has ``source``, ``date_order`` and ``set``.
    """
    counts = read.groupBy("source", "date_order", "set").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        declared = pdf["date_order"].iloc[0]
        pdf = pdf[pdf["set"] > 0]
        weight = fit_notations(pdf, declared if isinstance(declared, str) else None)
        return pd.DataFrame([(pdf["source"].iloc[0], weight.tolist())] if len(pdf) else [], columns=["source", "weights"])

    return materialize(counts.groupBy("source").applyInPandas(fit, "source string, weights array<double>"))


def _with_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    return left.join(F.broadcast(right), "source", "left") if few else salted_join(left, right, "source")


def infer_orders(values: DataFrame, systems: DataFrame) -> DataFrame:
    """``(source, date_order, posterior)``: month or day first, as the mixture of each source's own values tells.

    What ``systems`` declares isn't looked at. A source whose values tell nothing gets a null order and the posterior 0.5; one
    without any date has no row.
    """
    known = _systems(systems.withColumn("date_order", F.lit(None).cast("string")))
    few = known.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    weights = source_weights(readings(_with_source(values.select("source", "value"), known, few)))
    mdy, dmy = (F.col("weights")[NOTATIONS.index(k)] for k in ("mdy", "dmy"))
    part = F.greatest(mdy, dmy) / (mdy + dmy)
    return weights.select("source", F.when(part >= MIN_POSTERIOR, F.when(mdy > dmy, "mdy").otherwise("dmy")).alias("date_order"), part.alias("posterior"))


def normalize_timestamps(values: DataFrame, systems: DataFrame) -> DataFrame:
    """Adds ``status`` and ``utc_micros`` to rows with ``source`` and the text ``value``.

    ``systems`` gives ``kind`` (joined to ``source``), ``time_zone`` and ``date_order`` (``mdy``, ``dmy`` or null) of each source.
    ``status`` is ``resolved``; ``ambiguous`` (several readings and no posterior of ``MIN_POSTERIOR``); ``no_single_instant`` (a
    local time that never or twice occurred, or no known zone); ``impossible`` (a date that isn't in the calendar or no known
    notation); or ``no_date``, which nulls, blanks and words get. ``utc_micros`` is null unless resolved. Zone abbreviations are
    those of the source's zone. A source without a row in ``systems`` has no zone: its values without zone get no instant, all others
    resolve. A source listed twice keeps its smallest zone and order. Repeated rows stay repeated, empty tables stay empty, further
    columns are carried along unless they begin with ``_``.
    """
    known = _systems(systems)
    keep = [c for c in values.columns if c not in ("time_zone", "date_order", "abbreviations", "set", "status", "utc_micros")]
    few = known.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    read = materialize(readings(_with_source(values.select(*keep), known, few)).drop("time_zone", "abbreviations"))
    read = _with_source(read, source_weights(read), few)

    mixed = F.bit_count(F.col("set")) > 1
    single = F.log2(F.col("set").cast("double")).cast("int")
    # readings that mean the same need no choice
    lowest, highest = F.array_min("_readings"), F.array_max("_readings")
    same = F.array_position("_readings", lowest).cast("int") - 1
    share = F.transform("weights", lambda w, i: F.when(F.getbit(F.col("set"), i) == 1, w).otherwise(0.0))
    best, total = F.array_max("_share"), F.aggregate("_share", F.lit(0.0), lambda x, w: x + w)
    likely = F.when(best >= MIN_POSTERIOR * total, F.array_position("_share", best).cast("int") - 1)
    read = read.withColumn("_share", F.when(mixed & (lowest != highest), share))
    read = read.withColumn("_pick", fenced(F.when(F.col("set") == 0, None).when(~mixed, single).when(F.col("_share").isNull(), same).otherwise(likely)))
    # a day that only the order opposite to the declared one can read is no date
    orders = {name: NOTATIONS.index(name) for name in ("mdy", "dmy")}
    declared = F.when(F.col("date_order") == "mdy", F.col("_readings")[orders["mdy"]]).when(F.col("date_order") == "dmy", F.col("_readings")[orders["dmy"]])
    against = F.coalesce(F.col("date_order").isin("mdy", "dmy") & F.col("_pick").isin(*orders.values()) & declared.isNull(), F.lit(False))
    read = read.withColumn("_against", against)
    read = read.withColumn("_local", F.when(~F.col("_against"), F.col("_readings")[F.col("_pick")] + F.col("_time")))
    absolute = F.col("_pick") >= NOTATIONS.index("seconds")
    instant = (
        F.when(F.col("_local").isNull() | absolute, F.col("_local"))
        .when(F.col("_offset").isNotNull(), F.col("_local") - F.col("_offset") * 60_000_000)
        .when(F.col("_known"), to_instant(F.col("_local"), F.col("_name")))
    )
    out = read.withColumn("utc_micros", fenced(instant))
    status = (
        F.when(F.col("utc_micros").isNotNull(), "resolved")
        .when(F.col("_against"), "impossible")
        .when(F.col("set") == 0, F.when(F.col("value").rlike("[0-9]"), "impossible").otherwise("no_date"))
        .when(F.col("_pick").isNull(), "ambiguous")
        .otherwise(F.lit("no_single_instant"))
    )
    return out.withColumn("status", F.coalesce(status, F.lit("no_date"))).select(*keep, "status", "utc_micros")
