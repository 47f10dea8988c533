"""Heavy keys: found with a bounded sketch, spread over several partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this share of the rows is split; so there are at most 1/share such keys.
HOT_SHARE = 1 / 128
SKETCH_ITEMS = 8192


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> dict[str, float]:
    """Keys (as strings) with at least ``share`` of the rows, and their shares.

    A frequent-items sketch of fixed size is merged over the partitions, so nothing is shuffled by key and the
    driver gets at most ``1/share`` entries. Every key above ``1/SKETCH_ITEMS`` of the rows is tracked.
    """
    limit = math.ceil(1 / share)
    row = (
        df.select(key.cast("string").alias("k"))
        .where("k is not null")
        .agg(F.expr(f"approx_top_k(k, {limit}, {SKETCH_ITEMS})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    if row is None or not row["n"]:
        return {}
    return {x["item"]: x["count"] / row["n"] for x in row["top"] if x["count"] >= share * row["n"]}


def salt_counts(shares: dict[str, float], parallelism: int) -> dict[str, int]:
    """Number of pieces of each hot key, so that a piece is at most about one task's fair part."""
    return {k: max(2, min(parallelism, math.ceil(s * parallelism * 2))) for k, s in shares.items()}


def salts_of(key: Column, counts: dict[str, int]) -> Column:
    """Pieces of the key: a literal lookup over the few hot keys, 1 for all others."""
    if not counts:
        return F.lit(1)
    pairs = [F.lit(x) for kv in counts.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key.cast("string")), F.lit(1))


def parallelism_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism, 2)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join on one column whose hot keys, judged on the left side, are salted.

    The right side's rows of a hot key are repeated once per piece; the left side's go to one piece each.
    """
    counts = salt_counts(hot_keys(left, F.col(key)), parallelism_of(left))
    if not counts:
        return left.join(right, key, how)
    pieces = salts_of(F.col(key), counts)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if not left.schema[c].dataType.typeName().startswith("map")]), pieces.cast("long")).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def fenced(column: Column) -> Column:
    """The same value, which filters above don't reach through: pushed below, they would evaluate its whole expression again."""
    return F.when(F.rand(0) >= 0, column)
