"""A migration from records to stored results: normalise, resolve, map, find the lineage of exceptions, write.

Every stage is a frame made from the one before; only what several stages read is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayline.functions.service_codes import map_service_code
from drayline.operators.entities import exception_lineage
from drayline.operators.normalize import normalize_records
from drayline.operators.resolve import customer_clusters
from drayline.plans.materialize import materialize, release

#: Proposals below it need a review.
REVIEW_BELOW = 0.7
#: Fields of a customer that are kept, those of them that are never missing, and the target of proposals.
CUSTOMER_FIELDS = ("id", "name", "phone", "address", "email", "city", "state", "zip")
ALWAYS = ("id", "name", "phone", "address")
TARGET = "service_agreements"


def _map_of(fields: dict[str, Column]) -> Column:
    """Map of the fields that aren't null."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull()))


def normalized_records(records: DataFrame, record_id: str, columns: dict[str, str]) -> DataFrame:
    """``(id, raw_id, entity_type, fields, flags)`` of records of one table; ``columns`` gives the column of each field."""
    rows = normalize_records(records, record_id, columns)
    return rows.select(F.concat(F.lit("n-"), "record_id").alias("id"), F.col("record_id").alias("raw_id"), "entity_type", _map_of({f: F.col(f) for f in columns}).alias("fields"), "flags")


def normalize_events(normalized: DataFrame) -> DataFrame:
    """``(record_id, position, event, entity_type, field, note)``: of each record that it was normalised, then its flags in their order."""
    first = F.array(F.struct(F.lit("RecordNormalized").alias("event"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("note")))
    flags = F.transform("flags", lambda f: F.struct(F.lit("AmbiguityFlagged").alias("event"), f["field"].alias("field"), f["note"].alias("note")))
    rows = normalized.select(F.col("id").alias("record_id"), "entity_type", F.posexplode(F.concat(first, flags)).alias("position", "e"))
    return rows.select("record_id", "position", "e.event", "entity_type", "e.field", "e.note")


def resolve_entities(normalized: DataFrame) -> DataFrame:
    """``(id, entity_type, cluster_id, confidence, merged, canonical_fields)``.

    Customers become one entity per cluster, with the fields of its canonical record; all other records pass through. Of a
    customer's fields only those of ``CUSTOMER_FIELDS`` are kept. Equal records count once; records without an identifier are left
    out, without a type they are ``unknown``.
    """
    given = normalized.where("id is not null").withColumns({"entity_type": F.coalesce("entity_type", F.lit("unknown")), "fields": F.coalesce("fields", F.create_map().cast("map<string,string>"))})
    value = {f: F.try_element_at("fields", F.lit(f)) for f in CUSTOMER_FIELDS if f != "id"}
    shaped = given.where("entity_type = 'customer'").select("id", *[(F.coalesce(v, F.lit("")) if f in ALWAYS else v).alias(f) for f, v in value.items()])
    content = F.to_json(F.array_sort(F.map_entries("fields")))
    others = given.where("entity_type <> 'customer'").withColumn("content", content).dropDuplicates(["id", "entity_type", "content"]).select(
        F.concat(F.lit("e-"), "id").alias("id"), "entity_type", F.concat(F.lit("c-"), "id").alias("cluster_id"), F.lit(1.0).alias("confidence"), F.lit(False).alias("merged"), F.col("fields").alias("canonical_fields")
    )
    customers = materialize(shaped.distinct())
    if customers.isEmpty():
        return others
    clusters = customer_clusters(customers)
    # of an identifier with several records, the one with the longest name and email
    kept = [f for f in CUSTOMER_FIELDS if f != "id"]
    longest = F.struct((F.length("name") + F.length(F.coalesce("email", F.lit("")))).alias("size"), *kept)
    one = customers.groupBy(F.col("id").alias("canonical_id")).agg(F.max(longest).alias("r")).select("canonical_id", *[f"r.{f}" for f in kept])
    joined = clusters.join(one, "canonical_id")
    name = F.concat(F.lit("c-"), "cluster_id")
    merged = joined.select(
        name.alias("id"), F.lit("customer").alias("entity_type"), name.alias("cluster_id"), "confidence", "merged",
        _map_of({f: F.col("canonical_id" if f == "id" else f) for f in CUSTOMER_FIELDS}).alias("canonical_fields"),
    )
    return merged.unionByName(others)


def _mapped(entities: DataFrame) -> DataFrame:
    code = F.try_element_at("canonical_fields", F.lit("serviceCode"))
    return entities.withColumn("code", code).withColumn("m", map_service_code(F.col("code")))


def propose_mappings(entities: DataFrame) -> DataFrame:
    """``(id, resolved_entity_id, entity_type, target_table, target_id, confidence, rule_version, status, mapped_fields)`` of every entity with a service code.

    Blank codes and entities without one get none. Columns of a job are carried along as ``job_id``, if there is one.
    """
    job = [c for c in ("job_id",) if c in entities.columns]
    rows = _mapped(entities).where("m is not null")
    fields = F.struct(F.col("m.lob").alias("lineOfBusiness"), F.col("m.size_yards").alias("sizeYards"), "m.frequency", "m.retired", F.col("m.retired_as").alias("retiredAs"), "m.notes")
    return rows.select(
        *job, F.concat(F.lit("p-"), "id").alias("id"), F.col("id").alias("resolved_entity_id"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.lit(TARGET).alias("target_table"), F.concat(F.lit("ag-"), "id").alias("target_id"),
        F.col("m.confidence").alias("confidence"), F.col("m.version").alias("rule_version"), F.lit("proposed").alias("status"), fields.alias("mapped_fields"),
    )


def _exception(entities: DataFrame, prefix: str, kind: Column, severity: Column, summary: Column, evidence: Column, fix: Column) -> DataFrame:
    job = [c for c in ("job_id",) if c in entities.columns]
    return entities.select(
        *job, F.concat(F.lit(prefix), "id").alias("id"), kind.alias("exception_type"), severity.alias("severity"), summary.alias("summary"),
        evidence.alias("evidence"), fix.alias("suggested_fix"), F.lit("open").alias("review_status"),
    )


def mapping_exceptions(entities: DataFrame) -> DataFrame:
    """Agreements without a service code, and codes whose mapping is less sure than ``REVIEW_BELOW``."""
    rows = _mapped(entities).where("code is not null or entity_type = 'agreement'")
    missing = F.coalesce(F.col("code"), F.lit("")) == ""
    rows = rows.where(missing | (F.col("m.confidence") < REVIEW_BELOW))
    retired = F.format_string('Retired service code "%s" maps to "%s"; human confirmation required', F.col("code"), F.coalesce("m.retired_as", "m.lob", F.lit("unknown")))
    low = F.format_string('Low mapping confidence (%.3f) for "%s"', F.col("m.confidence"), F.col("code"))

    def pick(a: Column | str, b: Column | str) -> Column:
        return F.when(missing, a).otherwise(b)

    return _exception(
        rows, "exc-map-", pick("missing_service_code", "low_mapping_confidence"), pick("warning", "info"),
        F.when(missing, "Agreement record has no service code").when(F.col("m.retired"), retired).otherwise(low),
        pick(F.array("id"), F.array("id", "code")), pick("Provide a legacy service code or map manually", "Review mapping suggestion or add a rule"),
    )


def plain_mapping_exceptions(entities: DataFrame) -> DataFrame:
    """As :func:`mapping_exceptions`, by the other rule: only given codes count, and blank ones can't be mapped."""
    rows = _mapped(entities).where("code is not null").where(F.col("m").isNull() | (F.col("m.confidence") < REVIEW_BELOW))
    unmapped = F.col("m").isNull()
    number = F.regexp_replace(F.col("m.confidence").cast("string"), r"\.0$", "")
    return _exception(
        rows, "exc-", F.when(unmapped, "unmapped_service_code").otherwise("low_mapping_confidence"), F.when(unmapped, "warning").otherwise("info"),
        F.when(unmapped, F.format_string('Unmapped service code "%s"', F.col("code"))).otherwise(F.concat(F.lit("Low mapping confidence for "), "code")),
        F.when(unmapped, F.array("code")).otherwise(F.array(F.col("code"), number)), F.when(unmapped, "Map manually or add a mapping rule").otherwise("Review mapping suggestion"),
    )


def resolution_exceptions(clusters: DataFrame) -> DataFrame:
    """An exception for every cluster that isn't merged without a conflict; ``clusters`` is as ``customer_clusters`` gives it."""
    conflict = F.col("addresses") > 1
    name = F.concat(F.lit("c-"), "cluster_id")
    reason = F.when(conflict, F.concat(F.lit("Entity cluster "), name, F.lit(" has conflicts that need review"))).otherwise(
        F.concat(F.lit("Entity cluster "), name, F.format_string(" confidence (%.2f) is below auto-merge threshold", F.col("confidence")))
    )
    what = F.array(F.format_string("memberCount=%d", F.col("members")), F.format_string("confidence=%.4f", F.col("confidence")))
    rows = clusters.where(conflict | ~F.col("merged")).withColumn("id", name)
    return _exception(
        rows, "exc-", F.lit("entity_resolution"), F.when(conflict, "warning").otherwise("info"), reason, F.when(conflict, F.concat(what, "shown")).otherwise(what),
        F.when(conflict, "Review conflicting fields and pick canonical values").otherwise("Review cluster and confirm merge or split"),
    )


def valid_count(proposals: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: proposals less exceptions; below zero where there are more of these."""
    counted = proposals.select(F.lit(1).alias("x")).unionByName(exceptions.select(F.lit(-1).alias("x")))
    return counted.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("valid"))


def persist_job(out: str, job: str, tables: dict[str, DataFrame]) -> None:
    """Writes each table into its folder's partition of the job; a repeated run replaces what the job wrote before.

    Tables are written one after another, in the given order. An empty table leaves its partition empty.
    """
    for name, rows in tables.items():
        rows.drop("job_id").write.mode("overwrite").parquet(f"{out}/{name}/job_id={job}")


def run_migration(normalized: DataFrame, job: str, out: str) -> dict[str, DataFrame]:
    """Runs a job over normalised records and stores entities, proposals, exceptions and audit events; returns the stored tables.

    Exceptions get the entity they are about, with its confidence.
    """
    spark = normalized.sparkSession
    records = materialize(normalized.select("id", "entity_type", "fields"))
    entities = materialize(resolve_entities(records).withColumn("job_id", F.lit(job)))
    proposals = propose_mappings(entities)
    raised = mapping_exceptions(entities)
    lineage = exception_lineage(raised, entities).select("job_id", F.col("exception_id").alias("id"), F.col("entity_id").alias("resolved_entity_id"), "confidence", F.coalesce("entity_id", F.lit("unknown")).alias("source_record"))
    now = F.current_timestamp()
    exceptions = materialize(raised.join(lineage, ["job_id", "id"], "left").withColumn("created_at", now))
    counts = entities.groupBy("job_id").agg(F.count("*").alias("entities"), F.count_if("merged").alias("merged"))
    per = exceptions.groupBy("job_id").agg(F.count("*").alias("exceptions"))
    totals = counts.join(per, "job_id", "left")

    def event(kind: str, payload: dict[str, Column]) -> DataFrame:
        values = F.create_map(*[x for k, v in payload.items() for x in (F.lit(k), F.coalesce(v, F.lit(0)).cast("string"))])
        return totals.select(F.concat(F.lit(f"{kind}-"), "job_id").alias("id"), F.lit(kind).alias("type"), F.lit("pipeline").alias("actor"), values.alias("payload"), now.alias("at"))

    audit = event("CustomerResolved", {"resolvedCount": F.col("entities"), "autoMerged": F.col("merged")}).unionByName(event("JobCompleted", {"exceptionCount": F.col("exceptions")}))
    raised_events = exceptions.select(F.concat(F.lit("ExceptionRaised-"), "id").alias("id"), F.lit("ExceptionRaised").alias("type"), F.lit("pipeline").alias("actor"), F.create_map(F.lit("type"), "exception_type", F.lit("severity"), "severity").alias("payload"), F.col("created_at").alias("at"))
    persist_job(out, job, {"resolved_entities": entities, "proposals": proposals, "exceptions": exceptions, "audit_events": audit.unionByName(raised_events)})
    release(records, entities, exceptions)
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("resolved_entities", "proposals", "exceptions", "audit_events")}


def describe_event(kind: Column, payload: Column) -> Column:
    """Struct ``(message, level)`` of an audit event; ``payload`` is a map of texts, missing numbers count as 0."""

    def number(key: str) -> Column:
        return F.coalesce(F.try_element_at(payload, F.lit(key)).try_cast("long"), F.lit(0)).cast("string")

    def word(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(payload, F.lit(key)), F.lit(default))

    errors = number("parseErrorCount")
    failed = word("failed", "false") == "true"
    message = {
        "JobStarted": F.concat(F.lit("Parsing "), number("sourceFileCount"), F.lit(" source file(s)...")),
        "SourceParsed": F.concat(F.lit("Parsed source files, "), number("recordCount"), F.lit(" raw records ingested"), F.when(errors != "0", F.concat(F.lit(" ("), errors, F.lit(" parse errors)"))).otherwise(""), F.lit(".")),
        "RecordNormalized": F.concat(F.lit("Normalized "), number("normalizedCount"), F.lit(" records. "), number("flaggedCount"), F.lit(" flagged.")),
        "CustomerResolved": F.concat(F.lit("Resolved "), number("resolvedCount"), F.lit(" entities. "), number("autoMerged"), F.lit(" auto-merged, "), number("needsReview"), F.lit(" need review.")),
        "MappingProposed": F.concat(F.lit("Mapped "), number("proposalCount"), F.lit(" proposals. "), number("exceptionCount"), F.lit(" exceptions raised.")),
        "ExceptionRaised": F.concat(F.lit("Exception raised: "), word("type", "unknown"), F.lit(" ("), word("severity", "info"), F.lit(").")),
        "JobCompleted": F.when(failed, F.concat(F.lit("Job failed review: "), number("criticalExceptions"), F.lit(" critical exception(s) among "), number("exceptionCount"), F.lit(" total."))).otherwise(
            F.concat(F.lit("Job completed. "), number("proposalCount"), F.lit(" proposals, "), number("exceptionCount"), F.lit(" exceptions."))
        ),
    }
    text = kind
    for name, m in message.items():
        text = F.when(kind == name, m).otherwise(text)
    severity = word("severity", "info")
    level = (
        F.when((kind == "SourceParsed") & (errors != "0"), "warn").when((kind == "ExceptionRaised") & (severity == "critical"), "error")
        .when((kind == "ExceptionRaised") & (severity == "warning"), "warn").when((kind == "JobCompleted") & failed, "error").otherwise("info")
    )
    return F.struct(text.alias("message"), level.alias("level"))
