"""Reading resolved entities: pages, their exceptions, lineage of exceptions, and report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayline.functions.scalars import histogram_bucket

PAGE = 100
#: Prefixes of exceptions before the identifier of an entity, in the order in which they are tried.
PREFIXES = ("exc-map-", "exc-")


def entity_page(entities: DataFrame, cursor: str = "", size: int = PAGE, job: str | None = None, entity_type: str | None = None) -> DataFrame:
    """The next entities after a cursor in the order of their identifiers; one more than the page tells that there are more.

    Only those of a job and type, where given. Nulls of the identifier are on no page; without a cursor the first page comes.
    """
    chosen = entities.where(F.col("id") > cursor) if cursor else entities.where("id is not null")
    for column, value in (("job_id", job), ("entity_type", entity_type)):
        if value is not None:
            chosen = chosen.where(F.col(column) == value)
    return chosen.orderBy("id").limit(size + 1)


def entity_view(page: DataFrame, proposals: DataFrame, exceptions: DataFrame) -> DataFrame:
    """A page with the mapping proposal of each entity and all its exceptions, the oldest first.

    The confidence is the proposal's, without one the entity's. Only the page's few entities meet the other tables; an
    entity without exceptions has an empty list. Of exceptions of one time the smaller identifier comes first.
    """
    keys = F.broadcast(page.select("job_id", F.col("id").alias("resolved_entity_id")).distinct())
    shown = F.struct("created_at", "id", "exception_type", "severity", "summary", "evidence", "suggested_fix", "confidence", "review_status")
    listed = (
        exceptions.join(keys, ["job_id", "resolved_entity_id"]).groupBy("job_id", "resolved_entity_id").agg(F.array_sort(F.collect_set(shown)).alias("exceptions"))
        .withColumnRenamed("resolved_entity_id", "id")
    )
    mapped = proposals.join(keys, ["job_id", "resolved_entity_id"]).select("job_id", F.col("resolved_entity_id").alias("id"), F.col("confidence").alias("mapped_confidence"), "mapped_fields")
    joined = page.join(mapped, ["job_id", "id"], "left").join(listed, ["job_id", "id"], "left")
    empty = F.array().cast(listed.schema["exceptions"].dataType)
    return joined.withColumns({"confidence": F.coalesce("mapped_confidence", "confidence"), "exceptions": F.coalesce("exceptions", empty)}).drop("mapped_confidence")


def with_exceptions(entities: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Entities with the number of their exceptions, of open ones, and the first; exceptions are summed up before the join."""
    summed = exceptions.where("resolved_entity_id is not null").groupBy("job_id", F.col("resolved_entity_id").alias("id")).agg(
        F.count("*").alias("exceptions"),
        F.count_if(F.col("review_status") == "open").alias("open_exceptions"),
        F.min_by("exception_type", F.struct("created_at", F.col("id"))).alias("first_type"),
    )
    joined = entities.join(summed, ["job_id", "id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("exceptions", "open_exceptions")})


def exception_lineage(exceptions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each exception with the entity it is about: the first of its candidates that exists in the job.

    Candidates are the first piece of evidence, then the exception's identifier without the prefix that it has; without any, the
    confidence is 0 and the source unknown.
    """
    known = entities.select("job_id", F.col("id").alias("candidate"), F.col("confidence").alias("entity_confidence"), F.col("entity_type")).distinct()
    without = [F.when(F.startswith("id", F.lit(p)), F.substr("id", F.lit(len(p) + 1))) for p in PREFIXES]
    options = F.array(F.get("evidence", F.lit(0)), *without)
    tried = exceptions.select("job_id", F.col("id").alias("exception_id"), F.posexplode(options).alias("k", "candidate")).where("candidate is not null")
    hit = tried.join(known, ["job_id", "candidate"]).groupBy("job_id", "exception_id").agg(F.min_by(F.struct("candidate", "entity_confidence", "entity_type"), F.struct("k", "candidate")).alias("e"))
    return (
        exceptions.select("job_id", F.col("id").alias("exception_id")).distinct().join(hit, ["job_id", "exception_id"], "left")
        .select("job_id", "exception_id", F.col("e.candidate").alias("entity_id"), F.coalesce("e.entity_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("e.entity_type", F.lit("unknown")).alias("entity_type"))
    )


def confidence_histogram(rows: DataFrame, column: str = "confidence") -> DataFrame:
    """All ten buckets of a confidence, with counts and their part of all."""
    spark = rows.sparkSession
    counts = rows.where(F.col(column).isNotNull()).groupBy(histogram_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    dense = spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # ten rows
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    label = F.format_string("%.1f-%.1f", F.col("bucket") / 10, (F.col("bucket") + 1) / 10)
    return dense.withColumn("total", total).select("bucket", label.alias("label"), "n", F.coalesce(F.round(F.try_divide(F.col("n"), F.col("total")), 6), F.lit(0.0)).alias("part"))


def entity_breakdown(entities: DataFrame) -> DataFrame:
    """Number, merged ones and mean confidence by entity type."""
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if("merged").alias("merged"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("avg_confidence"))


def trailing_counts(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events per key in the trailing window that ends with each event, itself included.

    A key of any size is split by time: each event is counted within its own stretch of the window's length, and once more stands,
    only to be counted, in the next one. Events without a key are one key, those without a time are counted among themselves.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    stretch = F.floor(micros / span)
    placed = events.withColumns({"_at": micros, "_place": F.explode(F.when(micros.isNull(), F.array(F.struct(stretch.alias("part"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(stretch.alias("part"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("part"), F.lit(False).alias("own")))))})
    window = Window.partitionBy(key, "_place.part").orderBy("_at").rangeBetween(-span, Window.currentRow)
    return placed.withColumn("trailing", F.count("*").over(window)).where("_place.own").drop("_at", "_place")


def newest_first(rows: DataFrame, at: str, key: str = "id") -> DataFrame:
    """All rows, the newest first; of one time the smaller key first, rows without a time last."""
    return rows.orderBy(F.desc_nulls_last(at), key)


def oldest_first(rows: DataFrame, at: str, key: str = "id") -> DataFrame:
    """All rows, the oldest first; of one time the smaller key first, rows without a time last."""
    return rows.orderBy(F.asc_nulls_last(at), key)


def has_output(entities: DataFrame, job: str) -> bool:
    """Whether a job has any entity; one row is looked for."""
    return not entities.where(F.col("job_id") == job).limit(1).isEmpty()


def with_first_of(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The rows, and if none has a value in the column one more that has this one; its other columns are null."""
    one = rows.where(F.col(column).isNotNull()).limit(1).select(F.lit(1).alias("_n"))
    seed = rows.sparkSession.createDataFrame([(value,)], "value string").select(*[(F.col("value") if c == column else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(seed.join(F.broadcast(one), F.lit(True), "left_anti"))


def source_of_jobs(files: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Files that belong to one of the jobs; repeated jobs don't repeat files."""
    return files.join(jobs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
