"""Figures of a migration, as rows and as lines of comma-separated text; and the evaluation of rules on labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.functions.scalars import blocking_key, count_text, histogram_bucket, normalize_address, normalize_container_id, normalize_date, percent
from drayline.functions.service_codes import map_service_code
from drayline.sources.legacy import csv_text

#: Cases at least so sure aren't looked at by anyone.
SURE = 0.7
#: Share of cases that must go through by themselves.
LEAST_AUTO = 0.95


def safe_rate(part: Column, whole: Column) -> Column:
    """Part of the whole; 0 where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def breakdown(records: DataFrame, proposals: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """``(key, total, auto_mapped, exceptions, auto_map_rate, avg_confidence)`` by a column that all three frames have.

    Records of a null key are a group of their own. ``proposals`` also has ``confidence``. Counts are summed before they meet.
    """
    parts = records.groupBy(key).agg(F.count("*").alias("total")).withColumns({"auto_mapped": F.lit(0).cast("long"), "exceptions": F.lit(0).cast("long"), "sum": F.lit(0.0)})
    mapped = proposals.groupBy(key).agg(F.count("*").alias("auto_mapped"), F.sum(F.col("confidence").cast("double")).alias("sum")).withColumns({"total": F.lit(0).cast("long"), "exceptions": F.lit(0).cast("long")})
    raised = exceptions.groupBy(key).agg(F.count("*").alias("exceptions")).withColumns({"total": F.lit(0).cast("long"), "auto_mapped": F.lit(0).cast("long"), "sum": F.lit(0.0)})
    every = parts.unionByName(mapped).unionByName(raised).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("total", "auto_mapped", "exceptions", "sum")])
    return every.select(key, "total", "auto_mapped", "exceptions", safe_rate(F.col("auto_mapped"), F.col("total")).alias("auto_map_rate"), safe_rate(F.col("sum"), F.col("auto_mapped")).alias("avg_confidence"))


def summary(records: DataFrame, proposals: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: records, proposals and exceptions, with their rates; all 0 for empty tables."""
    counted = None
    for name, df in (("total", records), ("auto_mapped", proposals), ("exceptions", exceptions)):
        part = df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    row = counted.agg(*[F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("total", "auto_mapped", "exceptions")])
    return row.withColumns({"auto_map_rate": safe_rate(F.col("auto_mapped"), F.col("total")), "exception_rate": safe_rate(F.col("exceptions"), F.col("total"))})


def report_lines(totals: DataFrame, by_source: DataFrame, by_entity: DataFrame, histogram: DataFrame, job: str = "", silent_errors: int = 0) -> DataFrame:
    """``(section, position, line)``: the report as comma-separated text in four sections, each with its header at position 0.

    The inputs are those of :func:`summary`, :func:`breakdown` by ``source`` and by ``entity_type``, and of the histogram of confidences.
    """
    spark = totals.sparkSession

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    metrics = [("Job ID", F.lit(job)), ("Total Records", count_text(F.col("total"))), ("Auto-Mapped", count_text(F.col("auto_mapped"))), ("Exceptions", count_text(F.col("exceptions"))), ("Auto-Map Rate", percent(F.col("auto_map_rate"))), ("Exception Rate", percent(F.col("exception_rate"))), ("Silent Errors", F.lit(str(silent_errors)))]
    rows = totals.select(F.posexplode(F.array(*[csv_text([F.lit(k), v]) for k, v in metrics])).alias("position", "line")).select(F.lit("Summary").alias("section"), (F.col("position") + 1).alias("position"), "line")

    def placed(df: DataFrame, section: str, order: str, cells: list[Column]) -> DataFrame:
        # figures by source, type or bucket are few
        listed = df.select(F.struct(F.col(order).alias("key"), csv_text(cells).alias("line")).alias("x")).groupBy().agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return listed.select(F.posexplode("xs").alias("position", "x")).select(F.lit(section).alias("section"), (F.col("position") + 1).alias("position"), "x.line")

    rate = percent(F.col("auto_map_rate"))
    rows = rows.unionByName(placed(by_source, "By Source", "source", [F.coalesce("source", F.lit("")), text("total"), text("auto_mapped"), text("exceptions"), rate]))
    rows = rows.unionByName(placed(by_entity, "By Entity Type", "entity_type", [F.coalesce("entity_type", F.lit("")), text("total"), text("auto_mapped"), text("exceptions"), rate, percent(F.col("avg_confidence"))]))
    rows = rows.unionByName(placed(histogram, "Confidence Histogram", "bucket", [F.col("label"), text("n"), percent(F.col("part"))]))
    heads = [("Summary", "metric,value"), ("By Source", "source,totalRecords,autoMapped,exceptions,autoMapRate"), ("By Entity Type", "entityType,totalRecords,autoMapped,exceptions,autoMapRate,avgConfidence"), ("Confidence Histogram", "range,count,percentage")]
    return spark.createDataFrame([(s, 0, h) for s, h in heads], "section string, position int, line string").unionByName(rows)


def run_cases(cases: DataFrame) -> DataFrame:
    """``(id, entity_type, confidence, passed, actual)`` of labelled cases; each has ``input`` and ``expected``, maps of texts.

    A case passes if every expected field comes out. By type: a customer's blocking key, a site's and a route's fields in capitals,
    a container's identifier, an agreement's mapped code, a ticket's identifier and date. Other types have no output and no confidence.
    """

    def given(key: str) -> Column:
        return F.coalesce(F.try_element_at("input", F.lit(key)), F.lit(""))

    def made(fields: dict[str, Column]) -> Column:
        return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])

    # the larger rules stand in columns of their own, so that their code isn't repeated
    cases = cases.select("id", "entity_type", "input", "expected", map_service_code(given("serviceCode")).alias("_code"), normalize_container_id(given("containerId")).alias("_container"), normalize_date(given("date")).alias("_date"))
    code, container, day = F.col("_code"), F.col("_container"), F.col("_date.iso")
    outputs = {
        "customer": (made({"blockingKey": blocking_key(given("name"), given("phone"), given("address"))}), F.lit(1.0)),
        "site": (made({"name": F.upper(given("name")), "address": normalize_address(given("address")), "city": F.upper(given("city")), "state": F.upper(given("state")), "zip": given("zip")}), F.lit(1.0)),
        "container": (made({"containerId": container}), F.when(container != "", 1.0).otherwise(0.0)),
        "agreement": (F.when(code.isNotNull(), made({"lineOfBusiness": code["lob"], "sizeYards": code["size_yards"].cast("string"), "frequency": code["frequency"], "retired": code["retired"].cast("string")})), F.coalesce(code["confidence"], F.lit(0.0))),
        "route": (made({"templateId": given("templateId"), "name": F.upper(given("name")), "stops": given("stops"), "frequency": given("frequency")}), F.lit(1.0)),
        "ticket": (made({"ticketId": given("ticketId"), "containerId": container, "weightLbs": given("weightLbs"), "date": day}), F.when(day.isNotNull(), 1.0).otherwise(0.0)),
    }
    actual, confidence = F.lit(None).cast("map<string,string>"), F.lit(0.0)
    for kind, (fields, sure) in outputs.items():
        actual, confidence = F.when(F.col("entity_type") == kind, fields).otherwise(actual), F.when(F.col("entity_type") == kind, sure).otherwise(confidence)
    rows = cases.select("id", "entity_type", "expected", actual.alias("actual"), confidence.cast("double").alias("confidence"))
    right = F.forall(F.map_keys("expected"), lambda k: F.coalesce(F.try_element_at(F.col("actual"), k) == F.try_element_at(F.col("expected"), k), F.lit(False)))
    return rows.select("id", "entity_type", "confidence", F.coalesce(right, F.lit(False)).alias("passed"), "actual")


def case_outcome(passed: Column, confidence: Column) -> Column:
    """``auto`` (right and sure), ``silent_error`` (wrong and sure), else ``exception``."""
    sure = confidence >= SURE
    return F.when(passed & sure, "auto").when(sure, "silent_error").otherwise("exception")


def evaluation(results: DataFrame, *keys: str) -> DataFrame:
    """``(keys, total, auto_mapped, exceptions, silent_errors, auto_map_rate, exception_rate, avg_confidence, score, passes_gate)``.

    By any columns of the results, or over all without. ``score`` is the mean of 1 for a case that passed and half its confidence
    for another. The gate needs no silent error and a part of ``LEAST_AUTO`` by itself.
    """
    outcome = case_outcome(F.col("passed"), F.col("confidence"))
    counted = results.withColumn("outcome", outcome).groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("auto", "auto_mapped"), ("exception", "exceptions"), ("silent_error", "silent_errors"))],
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(F.col("passed"), 1.0).otherwise(F.col("confidence") * 0.5)), F.lit(0.0)).alias("score"),
    )
    rates = counted.withColumns({"auto_map_rate": safe_rate(F.col("auto_mapped"), F.col("total")), "exception_rate": safe_rate(F.col("exceptions"), F.col("total"))})
    return rates.withColumn("passes_gate", (F.col("silent_errors") == 0) & (F.col("auto_map_rate") >= LEAST_AUTO))


def calibration(results: DataFrame) -> DataFrame:
    """``(bucket, confidence, accuracy, n)``: by tenth of the confidence its mean and the part that passed; empty tenths have no row."""
    return results.groupBy(histogram_bucket(F.col("confidence")).alias("bucket")).agg(F.avg("confidence").alias("confidence"), F.avg(F.col("passed").cast("double")).alias("accuracy"), F.count("*").alias("n"))
