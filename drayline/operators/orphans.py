"""References to records that do not exist.

References and parent keys are brought into the same partitions, sorted by key and time, and merged in one linear pass
(a running window) over both streams. Each parent contributes the events of its validity interval; what a reference has
seen before it in the merged order says whether its target is missing, deleted or late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.plans.skew import hot_keys, parallelism_of, salt_counts, salts_of

_BLANKS = r"(?U)^\s+|\s+$"


def plain_key(value: Column) -> Column:
    """Key without surrounding white space and case; null when nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(value, _BLANKS, "")), F.lit(""))


def number_key(value: Column) -> Column:
    """Key of a container: its number without leading zeros; a text without digits stays a text."""
    text = plain_key(value)
    digits = F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1)
    return F.when(text.isNull(), None).when(digits == "", F.concat(F.lit("T:"), text)).otherwise(F.regexp_replace(digits, "^0+(?=.)", ""))


def parents(df: DataFrame, relation: str, key: Column, recorded_at: Column, deleted_at: Column | None, scope: Column | None = None) -> DataFrame:
    """Parent keys of one relation with their validity intervals."""
    return df.select(
        F.lit(relation).alias("relation"),
        F.concat_ws("\x1f", F.coalesce(scope, F.lit("")) if scope is not None else F.lit(""), key).alias("key"),
        recorded_at.alias("from_at"),
        (deleted_at if deleted_at is not None else F.lit(None).cast("timestamp")).alias("until_at"),
        key.alias("_k"),
    ).where("_k is not null").drop("_k")


def references(df: DataFrame, relation: str, table: str, record_id: Column, key: Column, at: Column, scope: Column | None = None) -> DataFrame:
    """Non-empty references of one table; ``at`` is the referencing row's time."""
    return df.select(
        F.lit(relation).alias("relation"),
        F.concat_ws("\x1f", F.coalesce(scope, F.lit("")) if scope is not None else F.lit(""), key).alias("key"),
        F.lit(table).alias("table_name"),
        record_id.alias("record_id"),
        at.alias("at"),
        key.alias("_k"),
    ).where("_k is not null").drop("_k")


def classify_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each reference with ``reason``: ``missing``, ``deleted``, ``late``, or null where its target is there.

    ``refs`` and ``targets`` come from :func:`references` and :func:`parents`. A reference holds if any parent of its key
    is recorded at or before it and not yet deleted. Otherwise it is ``missing`` without any parent of the key, ``deleted`` if one
    was deleted at or before it, else ``late``. A reference without a time can only be missing; a parent without
    ``from_at`` exists from the beginning; one deleted before it was recorded never holds. Empty inputs give no rows;
    empty targets make every reference missing. Repeated rows stay repeated. Hot keys are split: their references go
    to one piece each and the parents of the key to all pieces, so no task gets a key as a whole.
    """
    both = F.concat_ws("\x1f", F.col("relation"), F.col("key"))
    counts = salt_counts(hot_keys(refs, both), parallelism_of(refs))
    pieces = salts_of(both, counts)
    r = refs.select(
        "relation", "key", "table_name", "record_id", "at",
        F.pmod(F.xxhash64("record_id", "at"), pieces.cast("long")).cast("int").alias("piece"),
        F.col("at").alias("when"), F.lit(1).alias("turn"), F.lit(0).alias("opens"), F.lit(0).alias("closes"), F.lit(0).alias("there"), F.lit(0).alias("gone"),
    )
    sane = F.col("until_at").isNull() | F.col("from_at").isNull() | (F.col("until_at") > F.col("from_at"))

    def event(when: Column, opens: Column | int, closes: Column | int, there: int, gone: int) -> Column:
        return F.struct(when.cast("timestamp").alias("when"), *[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for n, x in (("opens", opens), ("closes", closes), ("there", there), ("gone", gone))])

    beginning = F.lit(None)
    events = F.array(
        event(beginning, 0, 0, 1, 0),
        event(F.col("from_at"), sane.cast("int"), 0, 0, 0),
        event(F.col("until_at"), 0, sane.cast("int"), 0, 1),
    )
    # the third event only exists where the parent was deleted
    events = F.filter(F.transform(events, lambda e, i: F.when((i < 2) | F.col("until_at").isNotNull(), e)), lambda e: e.isNotNull())
    p = (
        targets.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("e", F.explode(events))
        .select(
            "relation", "key", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("timestamp").alias("at"),
            "piece", "e.when", F.lit(0).alias("turn"), "e.opens", "e.closes", "e.there", "e.gone",
        )
    )
    # references without a time come first among those with null "when", but after the parents' beginnings
    merged = Window.partitionBy("relation", "key", "piece").orderBy(F.col("when").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = r.unionByName(p).select(
        "relation", "table_name", "record_id", "at", "turn",
        F.sum("there").over(merged).alias("there"),
        (F.sum("opens").over(merged) - F.sum("closes").over(merged)).alias("alive"),
        F.sum("gone").over(merged).alias("gone"),
    )
    return seen.where("turn = 1").select(
        "relation", "table_name", "record_id", "at",
        F.when(F.col("there") == 0, "missing")
        .when(F.col("at").isNull() | (F.col("alive") > 0), None)
        .when(F.col("gone") > 0, "deleted")
        .otherwise("late")
        .alias("reason"),
    )


def orphan_report(classified: DataFrame) -> DataFrame:
    """Orphans per table, month and reason."""
    return (
        classified.where("reason is not null")
        .groupBy("table_name", F.date_format("at", "yyyy-MM").alias("period"), "reason")
        .agg(F.count("*").alias("orphans"))
    )
