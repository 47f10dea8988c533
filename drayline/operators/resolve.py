"""Customers of one block that are alike, as clusters with a canonical record.

Customers that are equal in all compared fields are one form; only forms are compared, so copies cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayline.functions.scalars import WEIGHTS, blocking_key, comparable, customer_similarity, normalize_address
from drayline.plans.materialize import materialize, release
from drayline.plans.skew import salted_join

MERGE, AUTO_MERGE = 0.5, 0.9
#: Without a phone, addresses that share less than this part of their words can't reach ``MERGE``.
SHARED_WORDS = (MERGE - WEIGHTS["name"] - WEIGHTS["email"]) / WEIGHTS["address"] - 1e-9
#: Different addresses of a cluster that are shown.
SHOWN_ADDRESSES = 5


def block_customers(customers: DataFrame) -> DataFrame:
    """Different customers with their blocking key and their ``form``, the compared fields in one text."""
    c = customers.select("id", "name", "phone", "address", "email").where("id is not null").distinct()
    c = c.withColumn("block", blocking_key(F.coalesce("name", F.lit("")), F.col("phone")))
    c = c.withColumn("fields", comparable(*[F.col(x) for x in ("name", "phone", "address", "email")]))
    return c.withColumn("form", F.concat_ws("\x1f", "fields.name", "fields.phone", "fields.address", "fields.email"))


def similar_forms(forms: DataFrame) -> DataFrame:
    """``(block, a, b, score)`` of different forms of one block that are at least ``MERGE`` alike, ``a`` before ``b``.

    ``forms`` has ``block``, ``form`` and ``fields``. With a phone all forms of a block are compared, hot blocks in salted
    parts. A block without a phone may hold any part of the data; there two forms can only be so alike if their addresses share one of
    their rarest words, of which each form is looked up under as many as that needs.
    """

    def sides(df: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
        return tuple(df.select(*key, F.col("form").alias(s), F.col("fields").alias(f"{s}_fields")) for s in ("a", "b"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.where("a < b").select("block", "a", "b", customer_similarity("a_fields", "b_fields").alias("score")).where(F.col("score") >= MERGE)

    with_phone = scored(salted_join(*sides(forms.where("fields.phone <> ''"), "block"), "block", "inner"))
    bare = forms.where("fields.phone = ''")
    words = bare.select("block", "form", F.explode(F.array_distinct(F.split("fields.address", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    ranked = words.join(often, "word").groupBy("block", "form").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    enough = F.size("w") - F.ceil(F.size("w") * F.lit(SHARED_WORDS)).cast("int") + 1
    probes = ranked.select("block", "form", F.explode(F.transform(F.slice("w", F.lit(1), enough), lambda x: x["word"])).alias("word"))
    probes = probes.join(bare, ["block", "form"]).withColumn("at", F.concat_ws("\x1f", "block", "word"))
    left, right = sides(probes, "at", "block")
    return with_phone.unionByName(scored(salted_join(left, right.drop("block"), "at", "inner")).distinct())


def _forms(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("block", "form", "fields").agg(F.count_distinct("id").alias("n"))


def similar_pairs(blocked: DataFrame) -> DataFrame:
    """``(block, left_id, right_id, score)`` of customers of one block that are at least ``MERGE`` alike."""
    forms = _forms(blocked)
    own = forms.where("n > 1").withColumn("b_fields", F.col("fields")).select("block", F.col("form").alias("a"), F.col("form").alias("b"), customer_similarity("fields", "b_fields").alias("score"))
    linked = similar_forms(forms).unionByName(own)
    ids = blocked.select("block", "form", "id")
    pairs = linked.join(ids.withColumnsRenamed({"form": "a", "id": "x"}), ["block", "a"]).join(ids.withColumnsRenamed({"form": "b", "id": "y"}), ["block", "b"])
    pairs = pairs.where((F.col("x") < F.col("y")) | ((F.col("a") != F.col("b")) & (F.col("x") > F.col("y"))))
    return pairs.select("block", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "score").distinct()


def cluster_labels(pairs: DataFrame) -> DataFrame:
    """``(id, cluster_id)``: the least identifier that pairs lead to, by spreading labels and jumping along them."""
    edges = pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    edges = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")))
    while True:
        around = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(around, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        stepped = spread.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved"))
        fresh = materialize(stepped)
        release(labels)
        labels = fresh
        if fresh.where("moved").isEmpty():
            release(edges)
            return labels.select("id", F.col("label").alias("cluster_id"))


def customer_clusters(customers: DataFrame) -> DataFrame:
    """``(cluster_id, canonical_id, members, addresses, shown, confidence, merged, review)`` of every cluster, single customers too.

    The canonical record has the longest name and email together, of equal ones the last identifier. ``addresses`` counts
    different ones in normal form, no address being one of them; more than one is a conflict, and ``shown`` has the first
    ``SHOWN_ADDRESSES`` of them. ``confidence`` is the mean score of all pairs of the cluster, and 1
    for a single customer; from ``AUTO_MERGE`` on a cluster of several is merged, below that it needs a review.
    """
    blocked = materialize(block_customers(customers))
    forms = materialize(_forms(blocked))
    node = F.concat_ws("\x1f", "block", "form")
    pairs = similar_forms(forms).select(F.concat_ws("\x1f", "block", "a").alias("left_id"), F.concat_ws("\x1f", "block", "b").alias("right_id"))
    labels = cluster_labels(pairs).withColumnsRenamed({"id": "node", "cluster_id": "group"})
    grouped = materialize(forms.withColumn("node", node).join(labels, "node", "left").withColumn("group", F.coalesce("group", "node")).select("block", "form", "fields", "n", "group"))
    # all pairs of a cluster, those of equal forms by their number
    many = grouped.join(grouped.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1").select("group"), "group")
    left, right = (many.select("group", F.col("form").alias(s), F.col("fields").alias(f"{s}_fields"), F.col("n").alias(f"{s}_n")) for s in ("a", "b"))
    times = F.when(F.col("a") == F.col("b"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n"))
    each = salted_join(left, right, "group", "inner").where("a <= b").select("group", customer_similarity("a_fields", "b_fields").alias("s"), times.alias("t"))
    score = each.groupBy("group").agg(F.round(F.sum(F.col("s") * F.col("t")) / F.sum("t"), 6).alias("confidence"))
    size = F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("email", F.lit("")))
    written = normalize_address(F.coalesce("address", F.lit("")))
    by_address = materialize(
        blocked.join(grouped.select("block", "form", "group"), ["block", "form"])
        .groupBy("group", written.alias("written")).agg(F.min("id").alias("first"), F.max(F.struct(size.alias("size"), F.col("id").alias("id"))).alias("best"), F.count_distinct("id").alias("members"))
    )
    groups = by_address.groupBy("group").agg(F.min("first").alias("cluster_id"), F.max("best")["id"].alias("canonical_id"), F.sum("members").alias("members"), F.count("*").alias("addresses"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("first", "written"))
    shown = (
        by_address.withColumn("k", place).where(F.col("k") <= SHOWN_ADDRESSES)
        .groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "written"))), lambda x: x["written"]).alias("shown"))
    )
    groups = groups.join(shown, "group")
    joined = groups.join(score, "group", "left").withColumn("confidence", F.when(F.col("members") > 1, F.coalesce("confidence", F.lit(1.0))).otherwise(1.0))
    merged = (F.col("members") > 1) & (F.col("confidence") >= AUTO_MERGE)
    return joined.withColumns({"merged": merged, "review": (F.col("members") > 1) & ~merged}).drop("group")
