"""Queries of the migration as a whole: records to entities, proposals, exceptions, views and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.functions import scalars as S
from drayline.functions.service_codes import map_service_code
from drayline.operators import entities as E
from drayline.operators import migrate as M
from drayline.operators import report as R
from drayline.operators.resolve import customer_clusters
from drayline.plans.materialize import materialize, shared_folder
from drayline.queries.migration import _FLAGS, _PAIRS, FIELDS, _clean, _company, _phone
from drayline.queries.migration import SQL as RULES
from drayline.sources import legacy as L
from drayline.sources import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _normalized(spark: SparkSession, root: str, *tables: str) -> DataFrame:
    parts = None
    for table in tables or FIELDS:
        part = M.normalized_records(read_table(spark, root, table).distinct(), "id", FIELDS[table])
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _entities(spark: SparkSession, root: str) -> DataFrame:
    """Agreements as entities, with their normalised fields; customers are resolved by queries of their own."""
    return M.resolve_entities(_normalized(spark, root, "agreements"))


_CODES = "with m as (" + RULES["map_service_codes"] + "), a as (select distinct * from agreements)"
_PROPOSALS = f"""{_CODES}, a2 as (select a.*, m.* exclude (service_code) from a join m using (service_code)),
proposals as (select 'p-e-n-' || id as id, 'e-n-' || id as resolved_entity_id, 'agreement' as entity_type, 'service_agreements' as target_table, 'ag-e-n-' || id as target_id, cast(round(confidence * 1000) as bigint) as thousandths, version as rule_version, 'proposed' as status, lob, size_yards, frequency, source from a2),
raised as (
  select 'exc-map-e-n-' || id as id, 'missing_service_code' as exception_type, 'warning' as severity, 'Agreement record has no service code' as summary, 'e-n-' || id as evidence, 'Provide a legacy service code or map manually' as suggested_fix, source from a where coalesce(service_code, '') = ''
  union all select 'exc-map-e-n-' || id, 'low_mapping_confidence', 'info', case when retired then 'Retired service code "' || service_code || '" maps to "' || coalesce(retired_as, lob, 'unknown') || '"; human confirmation required'
    else 'Low mapping confidence (' || printf('%.3f', confidence) || ') for "' || service_code || '"' end, 'e-n-' || id || '|' || service_code, 'Review mapping suggestion or add a rule', source from a2 where confidence < 0.7)"""


@_query(f"{_PROPOSALS} select * exclude (source) from proposals")
def proposals_of_agreements(spark: SparkSession, root: str) -> DataFrame:
    p = M.propose_mappings(_entities(spark, root))
    return p.select("id", "resolved_entity_id", "entity_type", "target_table", "target_id", F.round(F.col("confidence") * 1000).cast("long").alias("thousandths"), "rule_version", "status", F.col("mapped_fields.lineOfBusiness").alias("lob"), F.col("mapped_fields.sizeYards").alias("size_yards"), "mapped_fields.frequency")


@_query(f"{_PROPOSALS} select * exclude (source) from raised")
def exceptions_of_mapping(spark: SparkSession, root: str) -> DataFrame:
    x = M.mapping_exceptions(_entities(spark, root))
    return x.select("id", "exception_type", "severity", "summary", F.array_join("evidence", "|").alias("evidence"), "suggested_fix")


@_query(f"""{_CODES}, a2 as (select a.*, m.* exclude (service_code) from a join m using (service_code))
select 'exc-e-n-' || id as id, 'unmapped_service_code' as exception_type, 'Unmapped service code "' || service_code || '"' as summary, service_code as evidence from a where service_code is not null and trim(service_code) = ''
union all select 'exc-e-n-' || id, 'low_mapping_confidence', 'Low mapping confidence for ' || service_code, service_code || '|' || regexp_replace(confidence::varchar, '\\.0$', '') from a2 where confidence < 0.7""")
def exceptions_of_plain_mapping(spark: SparkSession, root: str) -> DataFrame:
    x = M.plain_mapping_exceptions(_entities(spark, root))
    return x.select("id", "exception_type", "summary", F.array_join("evidence", "|").alias("evidence"))


@_query(f"{_PROPOSALS} select ((select count(*) from proposals) - (select count(*) from raised))::bigint as valid")
def valid_proposals(spark: SparkSession, root: str) -> DataFrame:
    e = materialize(_entities(spark, root))
    return M.valid_count(M.propose_mappings(e), M.mapping_exceptions(e))


@_query(f"with {_FLAGS}, n as (select count(*) n from (select distinct * from agreements)), f as (select count(*) n from (select distinct a.id, d.field, d.note from agreements a join dates d on d.id = a.id where d.v <> '' and d.note is not null)), g as (select count(distinct id) n from c where trim(container_id) <> '' and not regexp_matches(v, '^(RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?[0-9]{{1,6}}$')) select 'RecordNormalized' as event, n.n as n from n union all select 'AmbiguityFlagged', f.n + g.n from f, g")
def events_of_normalizing(spark: SparkSession, root: str) -> DataFrame:
    return M.normalize_events(_normalized(spark, root, "agreements")).groupBy("event").agg(F.count("*").alias("n"))


@_query(f"""
with s as (select distinct id, name, customer_id, address, city, state, zip, geocodable from sites), t as (select *, {_clean("name")} cn from s)
select 'e-n-' || id as id, case when starts_with(company, 'Container ') then 'container' when starts_with(company, 'Route ') then 'route' when trim(company) <> '' and trim(address) <> '' then 'site' else 'unknown' end as entity_type, 'c-n-' || id as cluster_id, 1.0::double as confidence, false as merged, company as name, address
from (select *, case when trim(name) <> '' then {_company("cn")} else name end company from t)""")
def entities_of_sites(spark: SparkSession, root: str) -> DataFrame:
    e = M.resolve_entities(_normalized(spark, root, "sites"))
    return e.select("id", "entity_type", "cluster_id", "confidence", "merged", F.try_element_at("canonical_fields", F.lit("name")).alias("name"), F.try_element_at("canonical_fields", F.lit("address")).alias("address"))


#: Clusters of the normalised customers, without those that a rule takes for another type.
_CLUSTERS = _PAIRS.replace(
    "with recursive c as (select distinct id, name, phone, address, email from customers)",
    f"""with recursive r as (select distinct 'n-' || id id, name, phone, address, email, {_clean("name")} cn from customers),
q as (select id, coalesce(case when trim(name) <> '' then {_company("cn")} else name end, '') as name, coalesce({_phone("phone")}, phone, '') as phone, coalesce(address, '') as address, email from r),
c as (select * from q where trim(name) <> '' and trim(phone) <> '' and not starts_with(name, 'Container ') and not starts_with(name, 'Route '))""",
)


@_query(_CLUSTERS + """,
edge as (select left_id a, right_id b from z where score >= 0.5 union select right_id, left_id from z where score >= 0.5),
reach(id, other) as (select id, id from c union select r.id, e.b from reach r join edge e on e.a = r.other),
label as (select id, min(other) cluster_id from reach group by 1),
g as (select cluster_id, arg_max(c.name, (length(c.name) + length(coalesce(c.email, '')), id)) as name, count(*) members from c join label using (id) group by 1)
select 'c-' || cluster_id as id, 'c-' || cluster_id as cluster_id, name from g""")
def entities_of_customers(spark: SparkSession, root: str) -> DataFrame:
    e = M.resolve_entities(_normalized(spark, root, "customers")).where("entity_type = 'customer'")
    return e.select("id", "cluster_id", F.try_element_at("canonical_fields", F.lit("name")).alias("name"))


@_query()
def exceptions_of_resolving(spark: SparkSession, root: str) -> DataFrame:
    x = M.resolution_exceptions(customer_clusters(read_table(spark, root, "customers")))
    return x.select("id", "severity", "summary", F.array_join("evidence", "|").alias("evidence"))


@_query()
def migration_run(spark: SparkSession, root: str) -> DataFrame:
    """All four tables through every stage into stored tables; how many rows each has."""
    stored = M.run_migration(_normalized(spark, root), "job", f"{shared_folder(spark)}/migration")
    parts = None
    for name, rows in stored.items():
        kind = F.col({"resolved_entities": "entity_type", "proposals": "entity_type", "exceptions": "exception_type", "audit_events": "type"}[name])
        part = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


_JOB = "(select min(job_id) from resolved_entities)"


@_query(f"""
with e as (select distinct job_id, id, entity_type, confidence from resolved_entities where job_id = {_JOB} and entity_type = 'agreement' order by id limit 101),
x as (select distinct job_id, resolved_entity_id, id, exception_type, created_at from exceptions),
p as (select job_id, resolved_entity_id id, list(id order by created_at, id) l from x group by all)
select e.job_id, e.id, round(e.confidence::double, 4) as confidence, coalesce(array_to_string(l, '|'), '') as exceptions from e left join p using (job_id, id)""")
def view_of_agreements(spark: SparkSession, root: str) -> DataFrame:
    """The first page of a job's agreements, with proposals (of which the tables have none) and exceptions in their order."""
    e = read_table(spark, root, "resolved_entities").select("job_id", "id", "entity_type", "confidence", "merged", "canonical_fields")
    job = e.agg(F.min("job_id")).first()[0] or ""
    mine = e.where((F.col("job_id") == job) & (F.col("entity_type") == "agreement")).dropDuplicates(["job_id", "id"])
    page = materialize(E.entity_page(mine))
    x = read_table(spark, root, "exceptions")
    view = E.entity_view(page, M.propose_mappings(page), x)
    return view.select("job_id", "id", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.array_join(F.transform("exceptions", lambda v: v["id"]), "|").alias("exceptions"))


@_query("select distinct id, exception_type, epoch_us(created_at) as created_at from exceptions where job_id = (select min(job_id) from exceptions) order by created_at, id")
def exceptions_in_order(spark: SparkSession, root: str) -> DataFrame:
    x = read_table(spark, root, "exceptions").select("job_id", "id", "exception_type", "created_at").distinct()
    job = x.agg(F.min("job_id")).first()[0]
    return E.oldest_first(x.where(F.col("job_id") == job), "created_at").select("id", "exception_type", F.unix_micros("created_at").alias("created_at"))


@_query("select distinct id, kind, epoch_us(ingested_at) as ingested_at from source_files order by ingested_at desc nulls last, id")
def files_newest_first(spark: SparkSession, root: str) -> DataFrame:
    return E.newest_first(read_table(spark, root, "source_files").select("id", "kind", "ingested_at").distinct(), "ingested_at").withColumn("ingested_at", F.unix_micros("ingested_at"))


@_query("select distinct id, reviewed_by, epoch_us(reviewed_at) as reviewed_at from exceptions where reviewed_at is not null order by reviewed_at, id")
def reviews_in_order(spark: SparkSession, root: str) -> DataFrame:
    x = read_table(spark, root, "exceptions").where("reviewed_at is not null").select("id", "reviewed_by", "reviewed_at").distinct()
    return E.oldest_first(x, "reviewed_at").withColumn("reviewed_at", F.unix_micros("reviewed_at"))


@_query("select distinct e.job_id, e.id, e.exception_type from exceptions e where job_id in (select job_id from resolved_entities where merged)")
def exceptions_of_merged_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Rows that belong to jobs with a merged entity: a filter by foreign key."""
    jobs = read_table(spark, root, "resolved_entities").where("merged").select("job_id")
    return E.source_of_jobs(read_table(spark, root, "exceptions").select("job_id", "id", "exception_type").distinct(), jobs)


@_query(f"""
select distinct id, exception_type, case exception_type {" ".join(f"when '{k}' then '{v}'" for k, v in S.EXCEPTION_LABELS.items())} else replace(exception_type, '_', ' ') end as label, printf('%.1f', confidence::double * 100) || '%' as shown from exceptions""")
def labels_of_exceptions(spark: SparkSession, root: str) -> DataFrame:
    x = read_table(spark, root, "exceptions").select("id", "exception_type", "confidence").distinct()
    return x.select("id", "exception_type", S.exception_label(F.col("exception_type")).alias("label"), S.percent(F.col("confidence").cast("double")).alias("shown")).distinct()


@_query(r"""
select distinct id, concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(zip, '')) as location from customers""")
def locations_of_customers(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "customers").select("id", S.location_text(F.col("city"), F.col("state"), F.col("zip")).alias("location")).distinct()


@_query(_CODES + """ select id, '$' || format('{:,}', rate_cents // 100) || '.' || lpad((rate_cents % 100)::varchar, 2, '0') as rate, rate_cents + 5 as more, cast(floor(rate_cents * 1.5 + 0.5) as bigint) as times,
 coalesce(case when lob <> '' then lob || coalesce(' (' || size_yards || 'yd)', '') end, 'Not mapped') as mapped from a left join m using (service_code) where rate_cents >= 0""")
def views_of_agreements(spark: SparkSession, root: str) -> DataFrame:
    a = read_table(spark, root, "agreements").where("rate_cents >= 0").distinct().withColumn("m", map_service_code(F.col("service_code")))
    rate = F.col("rate_cents")
    return a.select("id", S.shown_cents(rate.cast("string")).alias("rate"), (rate + 5).alias("more"), S.multiply_cents(rate, F.lit(1.5)).alias("times"), S.mapped_text(F.col("m.lob"), F.col("m.size_yards")).alias("mapped"))


_BREAKDOWN = """
t as (select source, count(*) total from a group by 1), p as (select source, count(*) auto_mapped, sum(thousandths) / 1000 s from proposals group by 1), x as (select source, count(*) exceptions from raised group by 1),
b as (select source, total, coalesce(auto_mapped, 0) auto_mapped, coalesce(exceptions, 0) exceptions, coalesce(auto_mapped, 0) / total r, coalesce(s / auto_mapped, 0) c from t left join p using (source) left join x using (source))"""


def _of_agreements(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Agreements, and their proposals and exceptions, each with the source."""
    a = read_table(spark, root, "agreements").distinct()
    e = materialize(M.resolve_entities(M.normalized_records(a, "id", FIELDS["agreements"])))
    source = a.select(F.concat(F.lit("e-n-"), "id").alias("resolved_entity_id"), "source")
    p = M.propose_mappings(e)
    x = M.mapping_exceptions(e).withColumn("resolved_entity_id", F.get("evidence", F.lit(0))).withColumn("entity_type", F.lit("agreement"))
    return a, e, p.join(source, "resolved_entity_id"), x.join(source, "resolved_entity_id")


@_query(f"{_PROPOSALS}, {_BREAKDOWN} select source, total, auto_mapped, exceptions, cast(round(r * 10000) as bigint) as rate, cast(round(c * 10000) as bigint) as avg_confidence from b")
def breakdown_by_source(spark: SparkSession, root: str) -> DataFrame:
    a, _, p, x = _of_agreements(spark, root)
    b = R.breakdown(a, p, x, "source")
    return b.select("source", "total", "auto_mapped", "exceptions", F.round(F.col("auto_map_rate") * 10000).cast("long").alias("rate"), F.round(F.col("avg_confidence") * 10000).cast("long").alias("avg_confidence"))


@_query(f"""{_PROPOSALS}, {_BREAKDOWN},
h as (select least(9, thousandths // 100)::int bucket, count(*) n from proposals group by 1), d as (select b::int bucket, coalesce(n, 0) n, coalesce(n, 0) / (select count(*) from proposals) part from range(10) r(b) left join h on h.bucket = b),
u as (select (select count(*) from a) total, (select count(*) from proposals) am, (select count(*) from raised) ex),
lines as (
  select 'Summary' as section, unnest([0,1,2,3,4,5,6,7]) as position, unnest(['metric,value', 'Job ID,job', 'Total Records,' || q(total), 'Auto-Mapped,' || q(am), 'Exceptions,' || q(ex), 'Auto-Map Rate,' || printf('%.1f', am / total * 100) || '%', 'Exception Rate,' || printf('%.1f', ex / total * 100) || '%', 'Silent Errors,0']) as line from u
  union all select 'By Source', 0, 'source,totalRecords,autoMapped,exceptions,autoMapRate' union all select 'By Source', row_number() over (order by source), concat_ws(',', source, total, auto_mapped, exceptions, printf('%.1f', r * 100) || '%') from b
  union all select 'By Entity Type', 0, 'entityType,totalRecords,autoMapped,exceptions,autoMapRate,avgConfidence' union all select 'By Entity Type', 1, 'agreement,' || sum(total) || ',' || sum(auto_mapped) || ',' || sum(exceptions) || ',' || printf('%.1f', sum(auto_mapped) / sum(total) * 100) || '%,' || printf('%.1f', sum(c * auto_mapped) / sum(auto_mapped) * 100) || '%' from b
  union all select 'Confidence Histogram', 0, 'range,count,percentage' union all select 'Confidence Histogram', bucket + 1, printf('%.1f-%.1f', bucket / 10, (bucket + 1) / 10) || ',' || n || ',' || printf('%.1f', part * 100) || '%' from d)
select section, position::bigint as position, line from lines""".replace("q(total)", "(case when total >= 1000 then '\"' || format('{:,}', total) || '\"' else total::varchar end)").replace("q(am)", "(case when am >= 1000 then '\"' || format('{:,}', am) || '\"' else am::varchar end)").replace("q(ex)", "(case when ex >= 1000 then '\"' || format('{:,}', ex) || '\"' else ex::varchar end)"))
def report_of_agreements(spark: SparkSession, root: str) -> DataFrame:
    """The report as lines of text, section by section."""
    a, _, p, x = _of_agreements(spark, root)
    kinds = a.withColumn("entity_type", F.lit("agreement"))
    lines = R.report_lines(R.summary(a, p, x), R.breakdown(a, p, x, "source"), R.breakdown(kinds, p, x, "entity_type"), E.confidence_histogram(p), "job")
    return lines.withColumn("position", F.col("position").cast("long"))


_CASES = r"""
with c as (select distinct id, canonical_id, source from containers where canonical_id is not null and id is not null),
v as (select *, upper(regexp_replace(regexp_replace(id, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) v from c), d as (select *, regexp_extract(v, '^(?:RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?([0-9]{1,6})$', 1) n from v),
r as (select *, case when n <> '' then 'RC-' || case when ltrim(n, '0') = '' then '0' else ltrim(n, '0') end else v end got from d),
s as (select source, got = canonical_id ok, case when got <> '' then 1.0 else 0.0 end conf from r)"""


def _cases(spark: SparkSession, root: str) -> DataFrame:
    """Identifiers of containers as they were typed, with those that they stand for."""
    c = read_table(spark, root, "containers").where("canonical_id is not null and id is not null").select("id", "canonical_id", "source").distinct()
    return c.select("id", "source", F.lit("container").alias("entity_type"), F.create_map(F.lit("containerId"), "id").alias("input"), F.create_map(F.lit("containerId"), "canonical_id").alias("expected"))


@_query(_CASES + """ select 'container' as entity_type, count(*) as total, count(*) filter (where ok and conf >= 0.7) as auto_mapped, count(*) filter (where conf < 0.7) as exceptions, count(*) filter (where not ok and conf >= 0.7) as silent_errors,
 cast(round(avg(case when ok then 1.0 else conf * 0.5 end) * 10000) as bigint) as score, count(*) filter (where not ok and conf >= 0.7) = 0 and count(*) filter (where ok and conf >= 0.7) / count(*) >= 0.95 as passes_gate from s""")
def evaluation_of_containers(spark: SparkSession, root: str) -> DataFrame:
    """How the rule for identifiers fares against the known ones."""
    e = R.evaluation(R.run_cases(_cases(spark, root)), "entity_type")
    return e.select("entity_type", "total", "auto_mapped", "exceptions", "silent_errors", F.round(F.col("score") * 10000).cast("long").alias("score"), "passes_gate")


@_query(_CASES + " select least(9, floor(conf * 10))::int as bucket, cast(round(avg(ok::int) * 10000) as bigint) as accuracy, count(*) as n from s group by 1")
def calibration_of_containers(spark: SparkSession, root: str) -> DataFrame:
    c = R.calibration(R.run_cases(_cases(spark, root)))
    return c.select("bucket", F.round(F.col("accuracy") * 10000).cast("long").alias("accuracy"), "n")


@_query()
def intake_of_lines(spark: SparkSession, root: str) -> DataFrame:
    """All lines as files of their kinds: good rows with their values, quarantined ones with the error."""
    lines = read_table(spark, root, "raw_lines").select(F.col("source_file_id").alias("source_file"), "line_no", "line")
    files = read_table(spark, root, "source_files").select(F.col("id").alias("source_file"), "kind")
    return L.intake(lines, files).withColumn("values", F.to_json("values"))


@_query(r"""
with d as (select distinct l.* from raw_lines l join source_files f on f.id = l.source_file_id where f.kind = 'legacy-export' and line_no > 1 and trim(line) <> '')
select source_file_id as source_file, line_no as row, case when length(line) > 96 then 'row exceeds fixed-width layout' end as error, case when length(line) <= 96 then trim(substr(line, 1, 24)) end as name, case when length(line) <= 96 then trim(substr(line, 83, 14)) end as contact from d""")
def rows_of_legacy_files(spark: SparkSession, root: str) -> DataFrame:
    r = L.read_rows(_lines_of(spark, root, "legacy-export"), "legacy-export")
    return r.select("source_file", "row", "error", F.try_element_at("values", F.lit("name")).alias("name"), F.try_element_at("values", F.lit("contact")).alias("contact"))


def _lines_of(spark: SparkSession, root: str, kind: str) -> DataFrame:
    files = read_table(spark, root, "source_files").where(F.col("kind") == kind).select(F.col("id").alias("source_file_id"))
    return read_table(spark, root, "raw_lines").distinct().join(files, "source_file_id", "left_semi").withColumnRenamed("source_file_id", "source_file")


@_query(r"""
with d as (select distinct l.* from raw_lines l join source_files f on f.id = l.source_file_id where f.kind = 'routepro-csv' and trim(line) <> ''),
n as (select *, row_number() over (partition by source_file_id order by line_no) - 1 as row from d),
c as (select *, len(regexp_extract_all(case when length(replace(line, '"', '')) % 2 <> length(line) % 2 then line || '"' else line end || ',', '[^",]*(?:"[^"]*"[^",]*)*,')) k from n),
h as (select source_file_id, k as want from c where row = 0)
select source_file_id as source_file, row, case when k < want then 'expected ' || want || ' columns, got ' || k end as error from c join h using (source_file_id) where row > 0""")
def rows_of_comma_files(spark: SparkSession, root: str) -> DataFrame:
    return L.read_rows(_lines_of(spark, root, "routepro-csv"), "routepro-csv").select("source_file", "row", "error")


@_query("""
with c as (select distinct id, name, phone, address from customers), n as (select *, row_number() over (order by id, name, phone, address) + 1 as line_no from c),
q as (select line_no, unnest(['id', 'name', 'phone', 'address']) f, unnest([id, name, phone, address]) v from n)
select 1::bigint as line_no, 'id,name,phone,address' as line
union all select line_no, array_to_string(list_transform([coalesce(id, ''), coalesce(name, ''), coalesce(phone, ''), coalesce(address, '')], lambda v: case when regexp_matches(v, '[",\\n]') then '"' || replace(v, '"', '""') || '"' else v end), ',') from n""")
def file_of_customers(spark: SparkSession, root: str) -> DataFrame:
    """Customers as lines of a comma-separated file. Their order is a total one, so the numbers need a sort of all rows."""
    c = read_table(spark, root, "customers").select("id", "name", "phone", "address").distinct()
    numbered = _numbered(c, "id", "name", "phone", "address")
    return L.file_lines(numbered, "routepro-csv", ["id", "name", "phone", "address"], "place")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``place``, from 1, in the order of the keys: sorted by ranges, counted by partition, never in one task."""
    placed = materialize(rows.orderBy(*[F.asc_nulls_last(k) for k in keys]).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    add = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("add"))
    return placed.join(F.broadcast(add), "part").withColumn("place", F.col("at") + F.col("add")).drop("part", "at", "add")
