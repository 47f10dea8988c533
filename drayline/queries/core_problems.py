"""Queries of the general data-quality problems: parse failures, timestamps, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.operators.orphans import classify_references, number_key, orphan_report, parents, plain_key, references
from drayline.operators.parse_rows import parse_rows
from drayline.operators.timestamps import infer_orders, normalize_timestamps
from drayline.sources import read_table


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return parse_rows(read_table(spark, root, "raw_lines"), read_table(spark, root, "source_files"), read_table(spark, root, "source_columns"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Data lines that cannot be loaded, with the reason."""
    bad = _parsed(spark, root).where(F.col("error").isin("quoting", "column_count", "invalid_value"))
    return bad.select("source_file_id", "line_no", F.col("error").alias("reason")).distinct()


def p2_loaded(spark: SparkSession, root: str) -> DataFrame:
    """Valid lines as values joined by a unit separator."""
    good = _parsed(spark, root).where("error is null")
    return good.select("source_file_id", "line_no", "kind", F.concat_ws("\x1f", "values").alias("loaded")).distinct()


def _instants(spark: SparkSession, root: str) -> DataFrame:
    dates = read_table(spark, root, "agreements").select(
        F.col("id").alias("agreement_id"), "source", F.expr("stack(2, 'start_date', start_date, 'end_date', end_date) as (field_name, value)")
    )
    return normalize_timestamps(dates, read_table(spark, root, "source_systems"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The UTC instant of every date value that means exactly one."""
    return _instants(spark, root).where("utc_micros is not null").select("agreement_id", "field_name", "utc_micros").distinct()


def p4_status(spark: SparkSession, root: str) -> DataFrame:
    """How many values of each source were resolved, ambiguous or no dates."""
    return _instants(spark, root).groupBy("source", "field_name", "status").agg(F.count("*").alias("n"))


def p4_orders(spark: SparkSession, root: str) -> DataFrame:
    """The order of day and month of each source, found without what the sources declare."""
    dates = read_table(spark, root, "agreements").select("source", F.expr("stack(2, start_date, end_date) as value"))
    return infer_orders(dates, read_table(spark, root, "source_systems")).select("source", "date_order")


def _classified(spark: SparkSession, root: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return read_table(spark, root, name)

    sites, containers, entities = table("sites"), table("containers"), table("resolved_entities")
    targets = (
        parents(sites, "site", plain_key(F.col("id")), F.col("recorded_at"), F.col("deleted_at"))
        .unionByName(parents(containers, "container", number_key(F.col("id")), F.col("recorded_at"), F.col("deleted_at")))
        .unionByName(parents(entities, "entity", plain_key(F.col("id")), F.col("recorded_at"), F.col("deleted_at"), F.col("job_id")))
    )
    refs = (
        references(containers, "site", "containers", F.col("id"), plain_key(F.col("site_id")), F.col("recorded_at"))
        .unionByName(references(table("agreements"), "container", "agreements", F.col("id"), number_key(F.col("container_id")), F.col("recorded_at")))
        .unionByName(references(table("exceptions"), "entity", "exceptions", F.col("id"), plain_key(F.col("resolved_entity_id")), F.col("created_at"), F.col("job_id")))
    )
    return classify_references(refs, targets)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """References whose target is missing, deleted or late."""
    return _classified(spark, root).where("reason is not null").select("table_name", "record_id", "reason", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphan_report(_classified(spark, root).distinct())


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p4_found": p4_found, "p4_status": p4_status, "p4_orders": p4_orders, "p6_found": p6_found, "p6_report": p6_report}

_ORPHANS = r"""
with target as (
  select 'site' rel, '' job, upper(trim(id, E' \t\n\r')) k, recorded_at f, deleted_at u from sites
  union select 'container', '', ltrim(regexp_extract(id, '([0-9]+)[^0-9]*$', 1), '0'), recorded_at, deleted_at from containers
  union select 'entity', job_id, upper(trim(id, E' \t\n\r')), recorded_at, deleted_at from resolved_entities
), ref as (
  select distinct 'site' rel, '' job, upper(trim(site_id, E' \t\n\r')) k, 'containers' table_name, id record_id, recorded_at t from containers
  union select 'container', '', ltrim(regexp_extract(container_id, '([0-9]+)[^0-9]*$', 1), '0'), 'agreements', id, recorded_at from agreements where trim(container_id) <> ''
  union select 'entity', job_id, upper(trim(resolved_entity_id, E' \t\n\r')), 'exceptions', id, created_at from exceptions
), judged as (
  select table_name, record_id, t, count(g.k) n, bool_or(g.f <= t and (g.u is null or g.u > t)) ok, bool_or(g.u <= t) gone
  from ref left join target g using (rel, job, k) where k <> '' group by all
), orphan as (
  select table_name, record_id, case when n = 0 then 'missing' when gone then 'deleted' else 'late' end as reason, strftime(t, '%Y-%m') as period from judged where ok is not true
)
"""
#: Lines as data, cut into values: separators outside quotes become unit separators, then each value is judged.
_P2 = r"""
with d as (select distinct l.source_file_id, l.line_no, f.kind, l.line, trim(l.line, E' \t\r') v from raw_lines l join source_files f on f.id = l.source_file_id where l.line is not null and l.line_no <> 1),
k as (select * from d where v <> '' and not (kind = 'transfer-spreadsheet' and starts_with(v, '#')) and not (kind = 'quickbooks-export' and regexp_matches(v, '^[ \t\r"]*(?i:total|report)([^0-9A-Za-z_]|$)'))),
s as (select kind, count(*) want, sum(width) wide from source_columns group by 1),
c as (select k.*, want, wide, case when kind = 'legacy-export' then null
  else string_split(array_to_string(list_transform(string_split(v, '"'), lambda p, i: case when i % 2 = 0 then p when kind = 'transfer-spreadsheet' then regexp_replace(p, ' *\t[ \t]*| {2,}[ \t]*', chr(31), 'g') else replace(p, ',', chr(31)) end), '"'), chr(31)) end cells from k join s using (kind)),
w as (select *, case when kind = 'legacy-export' then list_transform((select list({'a': a, 'w': width} order by pos) from (select pos, width, 1 + coalesce(sum(width) over (order by pos rows between unbounded preceding and 1 preceding), 0)::int a from source_columns where kind = 'legacy-export')), lambda x: trim(substr(rtrim(line, E' \t\r'), x.a, x.w), E' \t\r'))
  else list_transform(cells, lambda x: trim(x, E' \t\r')) end vals from c),
f as (select *, kind <> 'legacy-export' and ((length(v) - length(replace(v, '"', ''))) % 2 = 1 or len(list_filter(vals, lambda x: contains(x, '"') and not regexp_matches(x, '^"([^"]|"")*"$'))) > 0) bad_quote,
  case when kind = 'legacy-export' then length(rtrim(line, E' \t\r')) > wide else len(vals) <> want end bad_count,
  list_transform(vals, lambda x: case when kind <> 'legacy-export' and starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) plain from w),
t as (select source_file_id, line_no, list({'p': pos, 't': value_type, 'r': required} order by pos) spec from f join source_columns using (kind) group by all),
x as (select f.*, list_zip(list_transform(plain, lambda y: trim(y, E' \t\r')), spec) z from f join t using (source_file_id, line_no)),
r as (select *, len(list_filter(z, lambda y: y[2] is not null and case when coalesce(y[1], '') = '' then y[2].r
  when y[2].t = 'integer' then not regexp_matches(y[1], '^-?[0-9]+$') when y[2].t = 'decimal' then not regexp_matches(y[1], '^-?[0-9]+(\.[0-9]+)?$')
  when y[2].t = 'date_ymd' then not (regexp_matches(y[1], '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(y[1] as date) is not null)
  when y[2].t = 'date_mdy' then not (regexp_matches(y[1], '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') and try_cast(right(y[1], 4) || '-' || left(y[1], 2) || '-' || substr(y[1], 4, 2) as date) is not null) else false end)) > 0 bad_value from x),
j as (select *, case when bad_quote then 'quoting' when bad_count then 'column_count' when bad_value then 'invalid_value' end reason from r)"""

SQL = {
    "p2_found": _P2 + " select source_file_id, line_no, reason from j where reason is not null",
    "p2_loaded": _P2 + " select distinct source_file_id, line_no, kind, array_to_string(plain, chr(31)) as loaded from j where reason is null",
    "p4_orders": "select kind as source, date_order from source_systems",
    "p6_found": _ORPHANS + "select distinct table_name, record_id, reason, period from orphan",
    "p6_report": _ORPHANS + "select table_name, period, reason, count(*) as orphans from orphan group by all",
}
