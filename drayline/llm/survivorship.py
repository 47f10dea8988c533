"""Best representative of each duplicate group, by a latent model of two-sided source quality.

Every distinct value of a field within a cluster is a fact that is true or false; a cluster's field may have several true
ones. A source affirms a fact by carrying it, and denies it by carrying only other values of the field; a denial that came later
than the fact is another matter than one that came before. Expectation-maximisation infers how often each source
affirms and denies true facts and false ones, together with the facts' truth. Of the facts judged true all are retained;
the survivor is the one of them seen last. A late value of a source that is mostly wrong is judged false, and then an earlier
one survives. Facts with the same votes have the same posterior, so the model only sees how often each pattern of votes occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize, release
from drayline.plans.skew import salted_join

FIELDS = ("name", "phone", "email", "address")
#: Texts that people type into a field that must not stay empty.
FILLERS = (
    "unknown", "n/a", "na", "none", "null", "nil", "tbd", "tba", "test", "xxx", "-", "--", ".", "?", "0", "customer", "see notes", "see site", "see file",
    "no name", "noname", "no address on file", "no address", "same as billing", "rural - ask driver", "call office", "noemail", "no email", "none@none.example", "noreply@none.example", "pending", "do not use",
)
#: A value of so many clusters is a filler too if so many of them have a well-formed value that begins otherwise.
SHARED_CLUSTERS, CONTRADICTED = 12, 0.8
#: Groups with more values than this are searched for pieces by joining, not within one row.
MAX_VALUES_IN_ROW = 32
#: There a value is compared with those that have its rarest run of so many letters, or all of it if it is shorter.
RUN_OF_LETTERS = 4
#: Up to so many patterns of votes the rounds run in one process, beyond that on all executors; the sums are the same.
LOCAL_PATTERNS = 200_000
EM_ROUNDS = 50
#: Prior of truth of usable values, and what others get, which have no votes; prior counts of a source's votes on true and on
#: false facts: it affirms, denied before, denies later.
PRIOR, UNUSABLE = 0.75, 0.01
TRUE_VOTES, FALSE_VOTES = (20.0, 18.0, 2.0), (8.0, 12.0, 20.0)
MIN_TRUTH = 0.5

_DAMAGE = r"[\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{0080}-\x{009F}]"


def _plain(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def _identity(field: Column, value: Column) -> Column:
    """What makes two writings the same value."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(field == "phone", F.when(F.length(digits) >= 7, F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "")).otherwise(_plain(value))).otherwise(_plain(value))


def _well_formed(field: Column, value: Column) -> Column:
    """Whether a present value has the form of its field, as far as it can be seen from itself."""
    plain, digits = _plain(value), F.regexp_replace(value, "[^0-9]", "")
    phone = digits.rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & ~digits.rlike(r"^1?([0-9])\1{9}$") & value.rlike(r"^[+]?[0-9(][0-9 ().\-/]*$")
    email = plain.rlike(r"^[a-z0-9][a-z0-9._%+-]*@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.[a-z]{2,}$") & ~plain.contains("..")
    address = plain.rlike(r"[0-9]") & plain.rlike(r"(?U)\p{L}{2,}")
    name = plain.rlike(r"(?U)\p{L}{2,}")
    form = F.when(field == "phone", phone).when(field == "email", email).when(field == "address", address).otherwise(name)
    return form & ~value.rlike(_DAMAGE) & ~plain.isin(*FILLERS)


def _claims(members: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Present values, one row per record and field."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return (
        members.select("cluster_id", "record_id", "source", "updated_at", F.expr(f"stack({len(fields)}, {pairs}) as (field_name, value)"))
        .where(r"cluster_id is not null and record_id is not null and value rlike '(?U)\\S'")
        .distinct()
        .withColumn("fact", _identity(F.col("field_name"), F.col("value")))
    )


def _with_pieces(facts: DataFrame) -> DataFrame:
    """Adds ``piece``: whether the fact is only a part of another of its cluster and field."""
    size = facts.groupBy("cluster_id", "field_name").agg(F.count("*").alias("n"))
    large = materialize(size.where(F.col("n") > MAX_VALUES_IN_ROW).drop("n"))
    crowded = not large.isEmpty()
    rest = facts.join(large, ["cluster_id", "field_name"], "left_anti") if crowded else facts
    whole = F.exists("values", lambda v: (F.length(v) > F.length("fact")) & v.contains(F.col("fact")))
    keep = facts.columns
    small = (
        rest.groupBy("cluster_id", "field_name")
        .agg(F.collect_list(F.struct(*[c for c in keep if c not in ("cluster_id", "field_name")])).alias("rows"))
        .withColumn("values", F.transform(F.filter("rows", lambda r: ~r["damaged"]), lambda r: r["fact"]))
        .select("cluster_id", "field_name", "values", F.explode("rows").alias("r"))
        .select("cluster_id", "field_name", "values", "r.*")
        .withColumn("piece", whole)
        .select(*keep, "piece")
    )
    if not crowded:
        return small
    # whatever holds a value holds each of its runs of letters; so all holders of the rarest run are looked at
    key = ["cluster_id", "field_name"]
    some = facts.join(large, key, "left_semi")
    n = F.length("fact")

    def runs(size: Column) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.substring(F.col("fact"), k, size))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[runs(F.lit(k)) for k in range(1, RUN_OF_LETTERS + 1)]))
    holders = materialize(some.where(~F.col("damaged")).select(*key, F.col("fact").alias("longer"), F.explode(every).alias("run")))
    often = holders.groupBy(*key, "run").agg(F.count("*").alias("n"))
    asked = some.select(*key, "fact", F.explode(F.array_distinct(runs(F.least(n, F.lit(RUN_OF_LETTERS))))).alias("run"))
    rarest = asked.join(often, [*key, "run"]).groupBy(*key, "fact").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    holds = (F.length("longer") > n) & F.contains("longer", "fact")
    pieces = rarest.join(holders, [*key, "run"]).where(holds).select(*key, "fact").distinct().withColumn("found", F.lit(True))
    met = some.join(pieces, [*key, "fact"], "left").withColumn("piece", F.coalesce("found", F.lit(False))).select(*keep, "piece")
    return small.unionByName(met)


Pattern = tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], int]
Rates = dict[str, np.ndarray]


def _posterior(patterns: list[Pattern], rates: Rates) -> np.ndarray:
    """Each pattern's probability of truth under the sources' rates (rows true and false; columns the three votes)."""
    out = np.empty(len(patterns))
    for k, (*votes, _) in enumerate(patterns):
        odds = np.log(PRIOR) - np.log1p(-PRIOR)
        for column, sources in enumerate(votes):
            for s in sources:
                odds += np.log(rates[s][0, column]) - np.log(rates[s][1, column])
        out[k] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return out


def _tally(patterns: list[Pattern], rates: Rates) -> Rates:
    """Votes of each source on true and on false facts, as expected under its rates."""
    sums: Rates = {}
    for (*votes, n), p in zip(patterns, _posterior(patterns, rates).tolist(), strict=True):
        for column, sources in enumerate(votes):
            for s in sources:
                t = sums.setdefault(s, np.zeros((2, 3)))
                t[0, column] += n * p
                t[1, column] += n * (1 - p)
    return sums


def _rates(sums: Rates) -> Rates:
    prior = np.array([TRUE_VOTES, FALSE_VOTES])
    return {s: (prior + t) / (prior + t).sum(1, keepdims=True) for s, t in sums.items()}


def fit_sources(patterns: list[Pattern]) -> tuple[Rates, np.ndarray]:
    """Rates of each source's votes on true and false facts, and each pattern's probability of truth.

    A pattern is (affirming sources, sources that denied before, sources that deny later, number of facts).
    """
    rates = _rates({s: np.zeros((2, 3)) for *votes, _ in patterns for sources in votes for s in sources})
    for _ in range(EM_ROUNDS):
        fresh = _rates(_tally(patterns, rates))
        done, rates = all(np.abs(fresh[s] - rates[s]).max() < 1e-9 for s in rates), fresh
        if done:
            break
    return rates, _posterior(patterns, rates)


_PATTERN = "affirm array<string>, before array<string>, later array<string>"


def _patterns_of(pdf: pd.DataFrame) -> list[Pattern]:
    return [(tuple(a), tuple(b), tuple(c), int(n)) for a, b, c, n in zip(pdf["affirm"], pdf["before"], pdf["later"], pdf["n"], strict=True)]


def judge_patterns(patterns: DataFrame) -> DataFrame:
    """Adds ``p_true`` to patterns of votes (``affirm``, ``before``, ``later``, ``n``).

    Many patterns are tallied where they lie; only the sums by source come to the driver.
    """
    spark = patterns.sparkSession
    if patterns.limit(LOCAL_PATTERNS + 1).count() <= LOCAL_PATTERNS:
        pdf = patterns.toPandas()
        listed = sorted(_patterns_of(pdf))
        _, truth = fit_sources(listed)
        return spark.createDataFrame([(list(a), list(b), list(c), float(p)) for (a, b, c, _), p in zip(listed, truth, strict=True)], _PATTERN + ", p_true double")
    names = [r["s"] for r in patterns.select(F.explode(F.concat("affirm", "before", "later")).alias("s")).distinct().collect()]
    rates = _rates({s: np.zeros((2, 3)) for s in names})
    for _ in range(EM_ROUNDS):

        def tally(batches: Iterator[pd.DataFrame], rates: Rates = rates) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sums = _tally(_patterns_of(pdf), rates)
                yield pd.DataFrame({"s": list(sums), "t": [t.ravel().tolist() for t in sums.values()]})

        parts = patterns.mapInPandas(tally, "s string, t array<double>").groupBy("s").agg(*[F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(6)]).collect()
        fresh = _rates({s: np.zeros((2, 3)) for s in names} | {r["s"]: np.array(r[1:]).reshape(2, 3) for r in parts})
        done, rates = all(np.abs(fresh[s] - rates[s]).max() < 1e-9 for s in names), fresh
        if done:
            break

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="n").assign(p_true=_posterior(_patterns_of(pdf), rates))

    return patterns.select("affirm", "before", "later", "n").mapInPandas(judge, _PATTERN + ", p_true double")


def judge_facts(members: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """Claims, and the facts ``(cluster_id, field_name, fact, usable, p_true, last_at)``.

    See :func:`surviving_values` for what counts.
    """
    claims = materialize(_claims(members, fields))
    source = F.coalesce("source", F.lit(""))
    facts = materialize(claims.groupBy("cluster_id", "field_name", "fact").agg(
        F.max(_well_formed(F.col("field_name"), F.col("value"))).alias("well"),
        F.min(F.col("value").rlike(_DAMAGE)).alias("damaged"),
        F.max("updated_at").alias("last_at"),
        F.sort_array(F.collect_set(source)).alias("affirm"),
    ))
    pieced = materialize(_with_pieces(facts))
    release(facts)
    # of each cluster and field how its well-formed values begin
    begins = pieced.where("well").groupBy("cluster_id", "field_name").agg(F.min(F.substring("fact", 1, 2)).alias("low"), F.max(F.substring("fact", 1, 2)).alias("high"))
    often = pieced.groupBy("field_name", "fact").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_CLUSTERS).drop("n")
    begin = F.substring("fact", 1, 2)
    spread = salted_join(pieced.select("cluster_id", F.concat_ws("\x1f", "field_name", "fact").alias("value"), "field_name", "fact"), often.select(F.concat_ws("\x1f", "field_name", "fact").alias("value")), "value", "inner")
    against = spread.join(begins, ["cluster_id", "field_name"], "left").select("field_name", "fact", F.coalesce((F.col("low") != begin) | (F.col("high") != begin), F.lit(False)).alias("other"))
    fillers = against.groupBy("field_name", "fact").agg(F.avg(F.col("other").cast("double")).alias("part")).where(F.col("part") >= CONTRADICTED).select(F.concat_ws("\x1f", "field_name", "fact").alias("value"), F.lit(True).alias("filler"))
    named = pieced.withColumn("value", F.concat_ws("\x1f", "field_name", "fact"))
    judged = salted_join(named, fillers, "value").withColumn("usable", F.col("well") & ~F.col("piece") & F.col("filler").isNull())
    facts = materialize(judged.select("cluster_id", "field_name", "fact", "usable", "last_at", "affirm"))
    # of each cluster and field the sources that have a usable value, and when each had its last
    last = (
        claims.join(facts.where("usable").select("cluster_id", "field_name", "fact"), ["cluster_id", "field_name", "fact"])
        .groupBy("cluster_id", "field_name", source.alias("source"))
        .agg(F.max("updated_at").alias("at"))
        .groupBy("cluster_id", "field_name")
        .agg(F.collect_list(F.struct("source", "at")).alias("covering"))
        .select(F.concat_ws("\x1f", "cluster_id", "field_name").alias("group"), "covering")
    )
    voted = salted_join(facts.withColumn("group", F.concat_ws("\x1f", "cluster_id", "field_name")), last, "group").drop("group")
    others = F.filter(F.coalesce("covering", F.array().cast("array<struct<source:string,at:timestamp>>")), lambda c: ~F.array_contains("affirm", c["source"]))
    after = lambda c: F.coalesce(c["at"] > F.col("last_at"), c["at"].isNotNull())  # noqa: E731 -- null times are the oldest
    voted = voted.withColumns({
        "before": F.sort_array(F.transform(F.filter(others, lambda c: ~after(c)), lambda c: c["source"])),
        "later": F.sort_array(F.transform(F.filter(others, after), lambda c: c["source"])),
    }).drop("covering")
    voted = materialize(voted)
    release(pieced, facts)
    patterns = materialize(voted.where("usable").groupBy("affirm", "before", "later").agg(F.count("*").alias("n")))
    posterior = judge_patterns(patterns)
    judged = voted.join(posterior, ["affirm", "before", "later"], "left").withColumn("p_true", F.when(F.col("usable"), F.col("p_true")).otherwise(UNUSABLE))
    return claims, judged.select("cluster_id", "field_name", "fact", "usable", "p_true", "last_at")


def surviving_values(members: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(cluster_id, field_name, record_id, value, p_true)``: of each cluster and field the value to keep.

    ``members`` has ``cluster_id``, ``record_id``, ``source``, ``updated_at`` and the fields. A value is usable if it is present,
    has its field's form, isn't damaged, is no filler and no mere piece of another value of the cluster and field. The
    value to keep is the usable one judged true that was updated last, or without any judged true the likeliest; among equal
    times the greatest text. ``record_id`` is the smallest that carries it exactly as written. A cluster and field
    without a usable value gets no row. Null times are the oldest, null sources one source; records without a
    cluster or identifier are left out; repeated rows count once; an empty table gives no rows; other columns are not read.
    """
    claims, judged = judge_facts(members, fields)
    usable = judged.where("usable").select("cluster_id", "field_name", "fact", F.col("p_true"))
    key = ["cluster_id", "field_name", "fact"]
    carried = claims.where(_well_formed(F.col("field_name"), F.col("value"))).join(usable, key)
    believed = F.col("p_true") >= MIN_TRUTH
    order = F.struct(believed.alias("b"), F.when(believed, 0.0).otherwise(F.col("p_true")).alias("p"), F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    best = (
        carried.groupBy("cluster_id", "field_name", "value").agg(F.max(order).alias("o"), F.min("record_id").alias("record_id"), F.max("p_true").alias("p_true"))
        .groupBy("cluster_id", "field_name").agg(F.max_by(F.struct("record_id", "value", "p_true"), "o").alias("x"))
    )
    return best.select("cluster_id", "field_name", "x.record_id", "x.value", "x.p_true")


def retained_values(members: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """All usable facts judged true, with their probability; a field may keep several."""
    _, judged = judge_facts(members, fields)
    return judged.where(F.col("usable") & (F.col("p_true") >= MIN_TRUTH)).select("cluster_id", "field_name", "fact", "p_true")


def canonical_fields(members: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(cluster_id, canonical_fields)``: of each cluster the map of its fields to the values that survive.

    Fields without a usable value are missing from the map, clusters without any from the result.
    """
    best = surviving_values(members, fields)
    # at most one value of each field
    return best.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value")))).alias("canonical_fields"))
