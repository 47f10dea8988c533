"""Queries of the migration pipeline's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.functions import scalars as S
from drayline.functions.service_codes import map_service_code
from drayline.operators.entities import confidence_histogram, entity_breakdown, entity_page, exception_lineage, trailing_counts, with_exceptions
from drayline.operators.normalize import flag_rows, normalize_records
from drayline.operators.resolve import block_customers, customer_clusters, similar_pairs
from drayline.plans.materialize import materialize
from drayline.sources import read_table
from drayline.sources.legacy import csv_cells, csv_line, detect_kind, fixed_cells, row_counts, wide_cells

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The fields that the columns of the four tables hold.
FIELDS = {
    "customers": {"name": "name", "phone": "phone", "address": "address", "email": "email", "city": "city", "state": "state", "zip": "zip"},
    "sites": {"customerId": "customer_id", "name": "name", "address": "address", "city": "city", "state": "state", "zip": "zip", "geocodable": "geocodable"},
    "containers": {"containerId": "id", "siteId": "site_id", "sizeYards": "size_yards", "type": "container_type"},
    "agreements": {
        "customerId": "customer_id", "siteId": "site_id", "containerId": "container_id", "serviceCode": "service_code", "rateCents": "rate_cents",
        "startDate": "start_date", "endDate": "end_date", "status": "status", "billed": "billed",
    },
}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '[\s\x{{a0}}]+', ' ', 'g')"


def _strip(x: str) -> str:
    return _clean(rf"regexp_replace({x}, '(?i)\b(?:LLC|INC|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED)\b\.?', '', 'g')")


def _phonetic(x: str) -> str:
    v = f"upper({_strip(x)})"
    return rf"left({v}, 1) || left(regexp_replace({v}, '[AEIOUY\s]', '', 'g'), 3)"


def _phone(x: str) -> str:
    ten = rf"regexp_replace(regexp_replace({x}, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\1')"
    return f"case when regexp_matches({ten}, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') and substr({ten}, 2, 2) <> '11' and substr({ten}, 5, 2) <> '11' then '+1' || {ten} end"


def _address(x: str) -> str:
    v = f"upper({_clean(x)})"
    for long, short in S.STREET_FORMS.items():
        v = rf"regexp_replace({v}, '\b{long}\b', '{short}', 'g')"
    return v


def _company(x: str) -> str:
    """The clean name: words in capitals at their beginnings and after hyphens; a known last word in its one spelling."""
    forms = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.LEGAL_FORMS.items()) + "}"
    words = f"string_split({x}, ' ')"
    form = rf"{forms}[lower(regexp_replace({words}[-1], '^,|\.', '', 'g'))]"

    def title(t: str) -> str:
        return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '-')), ' ')"

    stem = f"regexp_replace(array_to_string({words}[1:len({words}) - 1], ' '), '[,.]+$', '')"
    return f"case when {x} = '' then '' when {form} is null then {title(x)} else concat_ws(' ', nullif({title(stem)}, ''), {form}) end"


_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_DATE_NOTES = rf"""
t as (select id, u.f field, regexp_replace(coalesce(u.v, ''), '^\s+|\s+$', '', 'g') v from (select id, unnest([{{'f': 'startDate', 'v': start_date}}, {{'f': 'endDate', 'v': end_date}}]) u from agreements)),
p as (select id, field, v,
  regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') a, regexp_matches(v, '^[0-9]{{1,2}}-[A-Za-z]{{3}}-([0-9]{{4}}|[0-9]{{2}})$') b, regexp_matches(v, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') c,
  list_position({_MONTHS}, lower(regexp_extract(v, '^[0-9]{{1,2}}-([A-Za-z]{{3}})-', 1))) m,
  regexp_extract(v, '-([0-9]{{4}}|[0-9]{{2}})$', 1) y from t),
q as (select *, case
  when a then split_part(v,'-',1) || '-' || lpad(split_part(v,'-',2),2,'0') || '-' || lpad(split_part(v,'-',3),2,'0')
  when b and m > 0 then case when length(y) = 4 then y when y >= '70' then '19' || y else '20' || y end || '-' || lpad(m::varchar,2,'0') || '-' || lpad(split_part(v,'-',1),2,'0')
  when c then split_part(v,'/',3) || '-' || lpad(split_part(v,'/',1),2,'0') || '-' || lpad(split_part(v,'/',2),2,'0') end d from p),
r as (select *, case when try_cast(d as date) is not null and left(d,4) <> '0000' then d end iso,
  case when v = '' then 'empty' when a or c then 'date' when b then case when m > 0 then 'date' else 'invalid month name' end
  when regexp_matches(v, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}$') then 'ambiguous 2-digit year' else 'unrecognized format' end shape from q),
dates as (select id, field, v, iso, shape in ('ambiguous 2-digit year', 'unrecognized format') as ambiguous, case when shape <> 'date' then shape when iso is null then 'invalid date' end as note from r)"""


@_query("with " + _DATE_NOTES + " select id, field, iso, ambiguous, note from dates")
def normalize_dates(spark: SparkSession, root: str) -> DataFrame:
    values = read_table(spark, root, "agreements").select("id", F.expr("stack(2, 'startDate', start_date, 'endDate', end_date) as (field, value)"))
    return values.select("id", "field", S.normalize_date(F.col("value")).alias("d")).select("id", "field", "d.iso", "d.ambiguous", "d.note")


@_query("select id, " + _phone("phone") + " as phone from customers")
def normalize_phones(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "customers").select("id", S.normalize_phone(F.col("phone")).alias("phone"))


@_query(r"""
with i as (select id as written from containers union all select container_id from agreements where container_id is not null),
t as (select written, upper(regexp_replace(regexp_replace(written, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) v from i),
d as (select written, v, regexp_extract(v, '^(?:RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?([0-9]{1,6})$', 1) n from t)
select written, case when n <> '' then 'RC-' || case when ltrim(n, '0') = '' then '0' else ltrim(n, '0') end else v end as container_id, count(*) as n from d group by all""")
def normalize_container_ids(spark: SparkSession, root: str) -> DataFrame:
    written = read_table(spark, root, "containers").select(F.col("id").alias("written")).unionByName(read_table(spark, root, "agreements").select(F.col("container_id").alias("written")).where("written is not null"))
    return written.groupBy("written").agg(F.count("*").alias("n")).withColumn("container_id", S.normalize_container_id(F.col("written")))


@_query("select id, " + _strip("name") + " as stripped, " + _phonetic("name") + " as phonetic, " + _address("address") + " as address from customers")
def name_and_address_keys(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "customers")
    return c.select("id", S.strip_legal_forms(F.col("name")).alias("stripped"), S.phonetic_key(F.col("name")).alias("phonetic"), S.normalize_address(F.col("address")).alias("address"))


@_query(f"with t as (select id, {_clean('name')} v from customers union all select id, {_clean('name')} from sites) select id, case when v is not null then {_company('v')} end as company from t")
def company_names(spark: SparkSession, root: str) -> DataFrame:
    named = read_table(spark, root, "customers").select("id", "name").unionByName(read_table(spark, root, "sites").select("id", "name"))
    return named.select("id", S.normalize_company_name(F.col("name")).alias("company"))


@_query(r"""
select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents,
  case when o_totalprice < 0 then '-$' else '$' end || format('{:,}', cast(floor(abs(cast(round(o_totalprice * 100) as bigint)) / 100) as bigint)) || '.' || lpad((abs(cast(round(o_totalprice * 100) as bigint)) % 100)::varchar, 2, '0') as shown
from orders""")
def money(spark: SparkSession, root: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = read_table(spark, root, "orders").select("o_orderkey", S.display_cents(cents).alias("shown"))
    return shown.select("o_orderkey", S.cents_of(F.col("shown")).alias("cents"), "shown")


@_query(r"""
with c as (select distinct service_code from agreements where trim(service_code) <> ''),
v as (select service_code, upper(trim(regexp_replace(service_code, '\s+', ' ', 'g'))) v from c),
p as (select *, regexp_extract(v, '^SW-OPEN-([0-9]{1,2})(?:YD)?$', 1) o, regexp_matches(v, '^SW-([A-Z]+)(?:-([0-9]{1,2}))?(?:YD)?(?:-([A-Z]+))?$') shaped,
 regexp_extract(v, '^SW-([A-Z]+)(?:-([0-9]{1,2}))?(?:YD)?(?:-([A-Z]+))?$', 1) t, regexp_extract(v, '^SW-([A-Z]+)(?:-([0-9]{1,2}))?(?:YD)?(?:-([A-Z]+))?$', 2) n, regexp_extract(v, '^SW-([A-Z]+)(?:-([0-9]{1,2}))?(?:YD)?(?:-([A-Z]+))?$', 3) w,
 regexp_extract(v, '(ROLLOFF|FRONTLOAD|RESIDENTIAL|COMM|RO|FL|RES)', 1) g, regexp_extract(v, '([0-9]{1,2})', 1) gn from v),
l as (select *, case when t in ('RO','ROLLOFF') then 'rolloff' when t in ('COMM','FL','FRONTLOAD') then 'frontload' when t in ('RES','RESIDENTIAL') then 'residential' end lob,
 case when g in ('RO','ROLLOFF') then 'rolloff' when g in ('COMM','FL','FRONTLOAD') then 'frontload' when g in ('RES','RESIDENTIAL') then 'residential' end guessed,
 case when w in ('W','WEEKLY') then 'weekly' when w in ('BW','BIW') then 'biweekly' when w in ('M','MONTHLY') then 'monthly' when w in ('OC','ONCALL') then 'oncall' end fq, try_cast(n as int) ni from p),
s as (select *, case when t in ('RO','COMM','RES') then 1000 else 920 end
 - case when n = '' or not case lob when 'rolloff' then ni in (10,20,30,40) when 'frontload' then ni in (2,4,6,8) else ni in (1,2) end then 400 else 0 end
 - case when fq is null and (w <> '' or lob = 'residential') then 400 else 0 end
 - case when t in ('RO','COMM') and w = '' and not regexp_matches(v, '-[0-9]{1,2}YD$') then 100 else 0 end pts from l)
select service_code, case when o <> '' then 'rolloff' when shaped then lob else guessed end as lob, case when o <> '' then try_cast(o as int) when shaped then ni else try_cast(gn as int) end as size_yards,
 case when o <> '' then 'weekly' when shaped and lob is not null then coalesce(fq, case when lob <> 'residential' and n <> '' then 'weekly' end) end as frequency,
 case when o <> '' then 600 when shaped and lob is not null then greatest(pts, 0) when shaped then 300 when guessed is not null then 450 else 300 end / 1000 as confidence, o <> '' as retired, case when o <> '' then 'SW-RO-' || o::int || 'YD' end as retired_as,
 array_to_string(list_filter(case when o <> '' then ['Open-top service is retired in the target model; migrate to the rolloff equivalent.']
  when shaped and lob is not null then [case when n = '' then 'Missing container size.' when not case lob when 'rolloff' then ni in (10,20,30,40) when 'frontload' then ni in (2,4,6,8) else ni in (1,2) end
    then 'Size ' || ni || ' yards is outside the ' || case lob when 'rolloff' then '10/20/30/40' when 'frontload' then '2/4/6/8' else '1/2' end || ' yard sizes offered for ' || lob || '.' end,
   case when fq is null and w <> '' then 'Unknown frequency token "' || w || '".' when fq is null and lob = 'residential' then 'Residential codes require an explicit frequency token.' end,
   case when t in ('RO','COMM') and w = '' and not regexp_matches(v, '-[0-9]{1,2}YD$') then 'Missing YD suffix.' end]
  when shaped then ['Unknown line-of-business token "' || t || '".', case when n <> '' then 'Parsed size ' || ni || ' yards, but the line of business is unknown.' end]
  else [case when guessed is not null then 'Code structure unrecognized; inferred line of business from token "' || g || '".' end, case when gn <> '' then 'Parsed size ' || gn::int || ' yards, unverified.' end,
   case when guessed is null then 'No recognizable line-of-business token; manual mapping required.' end, case when gn = '' then 'Missing container size.' end] end, lambda x: x is not null), ' | ') as notes, 'rules-v1' as version from s
""")
def map_service_codes(spark: SparkSession, root: str) -> DataFrame:
    codes = read_table(spark, root, "agreements").where("trim(service_code) <> ''").select("service_code").distinct()
    return codes.withColumn("m", map_service_code(F.col("service_code"))).select("service_code", "m.lob", "m.size_yards", "m.frequency", "m.confidence", "m.retired", "m.retired_as", F.array_join("m.notes", " | ").alias("notes"), "m.version")


_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_PAIRS = f"""
with recursive c as (select distinct id, name, phone, address, email from customers),
f as (select *, {_clean("coalesce(name, '')")} cn from c),
k as (select *, coalesce({_phonetic("coalesce(name, '')")}, '') || '|' || coalesce({_phone("phone")}, '') block,
  upper({_company("cn")}) n, coalesce({_phone("phone")}, '') p, {_address("coalesce(address, '')")} ad, lower(regexp_replace(coalesce(email, ''), '^\\s+|\\s+$', '', 'g')) e from f),
w as (select *, {_WORDS.format("ad")} t from k),
s as (select a.block, a.id left_id, b.id right_id,
  case when a.n = b.n then 1.0 else (greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n)) / greatest(length(a.n), length(b.n)) end::double ns, case when a.p <> '' and a.p = b.p then 1.0 else 0.0 end::double ps,
  case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) end::double ads,
  case when a.e <> '' and a.e = b.e then 1.0 else 0.0 end::double es
  from w a join w b on a.block = b.block and a.id < b.id),
z as (select *, round(case when ps = 1 and ads = 1 then greatest(raw, 0.9) else raw end, 6) score from (select *, ns * 0.31 + ps * 0.25 + ads * 0.34 + es * 0.1 raw from s))
"""


@_query(_PAIRS + "select distinct block, left_id, right_id, cast(floor(score * 1000 + 0.001) as bigint) as thousandths from z where score >= 0.5")
def similar_customers(spark: SparkSession, root: str) -> DataFrame:
    pairs = similar_pairs(materialize(block_customers(read_table(spark, root, "customers"))))
    return pairs.select("block", "left_id", "right_id", F.floor(F.col("score") * 1000 + 0.001).alias("thousandths")).distinct()


@_query(_PAIRS + """,
edge as (select left_id a, right_id b from z where score >= 0.5 union select right_id, left_id from z where score >= 0.5),
reach(id, other) as (select id, id from c union select r.id, e.b from reach r join edge e on e.a = r.other),
label as (select id, min(other) cluster_id from reach group by 1),
conf as (select x.cluster_id, avg(score) confidence from z join label x on x.id = left_id join label y on y.id = right_id where x.cluster_id = y.cluster_id group by 1),
g as (select cluster_id, arg_max(id, (length(coalesce(name, '')) + length(coalesce(email, '')), id)) canonical_id, count(distinct id) members, count(distinct ad) addresses from k join label using (id) group by 1)
select cluster_id, canonical_id, members, addresses, cast(floor(coalesce(confidence, 1) * 1000 + 0.001) as bigint) as thousandths, members > 1 and round(coalesce(confidence, 1), 6) >= 0.9 as merged, members > 1 and round(coalesce(confidence, 1), 6) < 0.9 as review from g left join conf using (cluster_id)""")
def clusters_of_customers(spark: SparkSession, root: str) -> DataFrame:
    return customer_clusters(read_table(spark, root, "customers")).withColumn("thousandths", F.floor(F.col("confidence") * 1000 + 0.001)).drop("confidence", "shown")


@_query("""
select id, case when lower(file_name) like '%quickbooks%' or lower(file_name) like '%qb%' then 'quickbooks-export'
 when lower(file_name) like '%transfer%' or lower(file_name) like '%scale%' or lower(file_name) like '%weigh%' then 'transfer-spreadsheet'
 when lower(file_name) like '%legacy%' or lower(file_name) like '%paper%' then 'legacy-export' else 'routepro-csv' end as detected from source_files""")
def detected_kinds(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "source_files").select("id", detect_kind(F.col("file_name")).alias("detected"))


@_query(r"""
with d as (select distinct * from raw_lines),
t as (select f.file_name, lower(f.file_name) like '%legacy%' legacy, trim(regexp_replace(coalesce(line, ''), '^\s+|\s+$', '', 'g')) v from d join source_files f on f.id = d.source_file_id)
select file_name, greatest(count(*) filter (where v <> '' and not starts_with(v, '#') and not regexp_matches(v, '(?i)^(total|report)\b') and not (legacy and regexp_matches(v, '(?i)^NAME/SERVICE'))) - case when any_value(legacy) then 0 else 1 end, 0) as records
from t group by file_name""")
def file_row_counts(spark: SparkSession, root: str) -> DataFrame:
    files = read_table(spark, root, "source_files").select(F.col("id").alias("source_file_id"), "file_name")
    return row_counts(read_table(spark, root, "raw_lines").distinct().join(files, "source_file_id"))


def _lines(spark: SparkSession, root: str, *kinds: str) -> DataFrame:
    files = read_table(spark, root, "source_files").where(F.col("kind").isin(*kinds)).select(F.col("id").alias("source_file_id"), "kind")
    return read_table(spark, root, "raw_lines").join(files, "source_file_id")


@_query(r"""
with l as (select r.source_file_id, r.line_no, case when (length(line) - length(replace(line, '"', ''))) % 2 = 1 then line || '"' else line end v from raw_lines r join source_files f on f.id = r.source_file_id where kind in ('routepro-csv', 'quickbooks-export')),
c as (select *, list_transform(string_split(array_to_string(list_transform(string_split(v, '"'), lambda p, i: case when i % 2 = 0 then p else replace(p, ',', chr(31)) end), '"'), chr(31)), lambda x: replace(regexp_replace(x, '"(([^"]|"")*)"', '\1', 'g'), '""', '"')) c from l)
select source_file_id, line_no, len(c) as n_cells, array_to_string(c, chr(31)) as cells, array_to_string(list_transform(c, lambda x: case when regexp_matches(x, '[",\n]') then '"' || replace(x, '"', '""') || '"' else x end), ',') as rewritten from c""")
def csv_cells_of_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, root, "routepro-csv", "quickbooks-export").withColumn("cells", csv_cells(F.col("line")))
    return lines.select("source_file_id", "line_no", F.size("cells").alias("n_cells"), F.array_join("cells", "\x1f").alias("cells"), csv_line(F.col("cells")).alias("rewritten"))


@_query(r"""
select r.source_file_id, r.line_no, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(line), '[ \t]{2,}'), lambda x: regexp_replace(trim(x), '^"(.*)"$', '\1')), lambda x: x <> ''), chr(31)) as cells
from raw_lines r join source_files f on f.id = r.source_file_id where kind = 'transfer-spreadsheet'""")
def wide_cells_of_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, root, "transfer-spreadsheet")
    return lines.select("source_file_id", "line_no", F.array_join(wide_cells(F.col("line")), "\x1f").alias("cells"))


@_query(r"""
select r.source_file_id, r.line_no, array_to_string([trim(substr(line,1,24)), trim(substr(line,25,14)), trim(substr(line,39,30)), trim(substr(line,69,8)), trim(substr(line,77,6)), trim(substr(line,83,14))], chr(31)) as cells
from raw_lines r join source_files f on f.id = r.source_file_id where kind = 'legacy-export'""")
def fixed_cells_of_lines(spark: SparkSession, root: str) -> DataFrame:
    return _lines(spark, root, "legacy-export").select("source_file_id", "line_no", F.array_join(fixed_cells(F.col("line")), "\x1f").alias("cells"))


@_query("""
with t as (select distinct source_file_id || ':' || line_no || ':' || line x, source_file_id, line_no from raw_lines where line is not null)
select source_file_id, line_no, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(list_filter(string_split(x, ''), lambda c: c <> ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) as hash from t""")
def content_hash(spark: SparkSession, root: str) -> DataFrame:
    lines = read_table(spark, root, "raw_lines").where("line is not null").distinct()
    return lines.select("source_file_id", "line_no", S.fnv1a(F.concat_ws(":", "source_file_id", "line_no", "line")).alias("hash"))


@_query("""
with h as (select least(9, floor(confidence::double * 10))::int bucket, count(*) n from exceptions where confidence is not null group by 1), t as (select sum(n) t from h)
select b::int as bucket, printf('%.1f-%.1f', b / 10, (b + 1) / 10) as label, coalesce(n, 0)::bigint as n, coalesce(round(n / t, 6), 0)::double as part from range(10) r(b) cross join t left join h on h.bucket = b""")
def exception_confidence(spark: SparkSession, root: str) -> DataFrame:
    return confidence_histogram(read_table(spark, root, "exceptions").select(F.col("confidence").cast("double").alias("confidence")))


@_query("select entity_type, count(*) as n, count(*) filter (where merged) as merged, round(avg(confidence::double), 4) as avg_confidence from resolved_entities group by 1")
def entity_types(spark: SparkSession, root: str) -> DataFrame:
    return entity_breakdown(read_table(spark, root, "resolved_entities"))


@_query("""
with x as (select job_id, resolved_entity_id id, count(*) n, count(*) filter (where review_status = 'open') o, arg_min(exception_type, (created_at, id)) f from (select distinct job_id, id, exception_type, review_status, resolved_entity_id, created_at from exceptions) where resolved_entity_id is not null group by all)
select e.job_id, e.id, e.entity_type, coalesce(n, 0) as exceptions, coalesce(o, 0) as open_exceptions, f as first_type from (select distinct job_id, id, entity_type from resolved_entities) e left join x using (job_id, id)""")
def entities_with_exceptions(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "resolved_entities").select("job_id", "id", "entity_type").distinct()
    x = read_table(spark, root, "exceptions").select("job_id", "id", "exception_type", "review_status", "resolved_entity_id", "created_at").distinct()
    return with_exceptions(e, x)


_PAGE_JOB = "(select min(job_id) from resolved_entities)"


@_query(f"select distinct job_id, id, entity_type, confidence, merged from resolved_entities where job_id = {_PAGE_JOB} and entity_type = 'customer' and id > 'c-000000100' order by id limit 101")
def page_of_entities(spark: SparkSession, root: str) -> DataFrame:
    """The page after a cursor, of one job's customers."""
    e = read_table(spark, root, "resolved_entities")
    return entity_page(e.select("job_id", "id", "entity_type", "confidence", "merged").where(F.col("job_id") == _first_job(e)).distinct(), "c-000000100", entity_type="customer")


def _first_job(entities: DataFrame) -> str:
    return entities.agg(F.min("job_id")).first()[0] or ""


@_query("""
with e as (select distinct job_id, id, confidence, entity_type from resolved_entities), x as (select distinct job_id, id, evidence from exceptions),
c as (select job_id, id, 0 k, evidence[1] c from x union all select job_id, id, 1, substr(id, 9) from x where starts_with(id, 'exc-map-') union all select job_id, id, 2, substr(id, 5) from x where starts_with(id, 'exc-')),
h as (select c.job_id, c.id, arg_min({'id': e.id, 'c': e.confidence, 't': e.entity_type}, (k, c)) v from c join e on e.job_id = c.job_id and e.id = c.c group by all)
select distinct x.job_id, x.id as exception_id, v.id as entity_id, round(coalesce(v.c, 0)::double, 4) as confidence, coalesce(v.t, 'unknown') as entity_type from x left join h using (job_id, id)""")
def lineage(spark: SparkSession, root: str) -> DataFrame:
    x = read_table(spark, root, "exceptions").select("job_id", "id", "evidence")
    found = exception_lineage(x, read_table(spark, root, "resolved_entities"))
    return found.withColumn("confidence", F.round(F.col("confidence").cast("double"), 4)).distinct()


@_query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as trailing from events")
def trailing_events(spark: SparkSession, root: str) -> DataFrame:
    return trailing_counts(read_table(spark, root, "events"), "user_id", "ts", 3600).select("event_id", "trailing")


@_query("""
select 'customers' as table_name, case when starts_with(name, 'Container ') then 'container' when starts_with(name, 'Route ') then 'route' when trim(phone) <> '' and trim(name) <> '' then 'customer' when trim(name) <> '' and trim(address) <> '' then 'site' else 'unknown' end as kind, count(*) as n from customers group by all
union all select 'sites', case when starts_with(name, 'Container ') then 'container' when starts_with(name, 'Route ') then 'route' when trim(name) <> '' and trim(address) <> '' then 'site' else 'unknown' end, count(*) from sites group by all
union all select 'containers', case when size_yards is not null or trim(container_type) <> '' then 'container' else 'unknown' end, count(*) from containers group by all
union all select 'agreements', case when trim(service_code) <> '' or rate_cents is not null or (trim(start_date) <> '' and trim(status) <> '') then 'agreement' else 'unknown' end, count(*) from agreements group by all""")
def inferred_types(spark: SparkSession, root: str) -> DataFrame:
    parts = None
    for table, columns in FIELDS.items():
        kind = S.infer_entity_type({f: F.col(c).cast("string") for f, c in columns.items()})
        part = read_table(spark, root, table).select(F.lit(table).alias("table_name"), kind.alias("kind"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("table_name", "kind").agg(F.count("*").alias("n"))


#: Patterns of :func:`_by_flag`: a phone, a container's number.
_FLAGS = f"""
{_DATE_NOTES},
c as (select id, container_id, upper({_clean("container_id")}) v from agreements),
flags as (
  select 'agreements' as table_name, field, note from dates where v <> '' and note is not null
  union all select 'agreements', 'containerId', 'unrecognized container id' from c where trim(container_id) <> '' and not regexp_matches(v, '^(RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?[0-9]{{1,6}}$')
  union all select 'customers', 'phone', 'not E.164' from customers where trim(phone) <> '' and {_phone("phone")} is null
  union all select 'containers', 'containerId', 'unrecognized container id' from containers where trim(id) <> '' and not regexp_matches(upper({_clean("id")}), '^(RC[- ]?|BIN[- ]?|CONTAINER[- ]?)?[0-9]{{1,6}}$'))"""


@_query("with " + _FLAGS + " select table_name, field, note, count(*) as n from flags group by all")
def flags_of_records(spark: SparkSession, root: str) -> DataFrame:
    """How often each flag stands in customers, sites, containers and agreements, over all fields that have a rule."""
    parts = None
    for table, columns in FIELDS.items():
        part = flag_rows(normalize_records(read_table(spark, root, table), "id", columns)).withColumn("table_name", F.lit(table))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("table_name", "field", "note").agg(F.count("*").alias("n"))


@_query("""
select 'customers' as table_name, count(*) as n, count(distinct id) as ids, count(*) filter (where coalesce(trim(phone), '') = '') as empty from customers
union all select 'sites', count(*), count(distinct id), count(*) filter (where not coalesce(geocodable, false)) from sites
union all select 'agreements', count(*), count(distinct id), count(*) filter (where coalesce(trim(container_id), '') = '') from agreements""")
def dirt_summary(spark: SparkSession, root: str) -> DataFrame:
    parts = []
    for name, empty in (("customers", F.coalesce(F.trim("phone"), F.lit("")) == ""), ("sites", ~F.coalesce("geocodable", F.lit(False))), ("agreements", F.coalesce(F.trim("container_id"), F.lit("")) == "")):
        parts.append(read_table(spark, root, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(empty).alias("empty")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
