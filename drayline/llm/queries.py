"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm.addresses import located_pairs, location_key, resolve_addresses
from drayline.llm.components import connected_components
from drayline.llm.leaks import find_leaks
from drayline.llm.names import linked_pairs, resolve_names
from drayline.llm.packing import count_tokens, pack, packing_quality
from drayline.llm.survivorship import FILLERS, canonical_fields, retained_values, surviving_values
from drayline.llm.truncation import judge_endings, truncation_rates
from drayline.sources import read_table


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Every record of an accepted pair with its group's least identifier."""
    return connected_components(read_table(spark, root, "match_pairs").where("is_match"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text was cut off."""
    return judge_endings(read_table(spark, root, "documents")).where("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_rates(judge_endings(read_table(spark, root, "documents")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Of each cluster and field the record whose value survives."""
    return surviving_values(read_table(spark, root, "cluster_members")).select("cluster_id", "field_name", "record_id")


def p5_retained(spark: SparkSession, root: str) -> DataFrame:
    """All values judged true, several to a field where the evidence allows."""
    return retained_values(read_table(spark, root, "cluster_members"))


def p5_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Entities with the fields that survive in their cluster."""
    fields = canonical_fields(read_table(spark, root, "cluster_members"))
    e = read_table(spark, root, "resolved_entities").where("entity_type = 'customer'").select("job_id", "id", "cluster_id").distinct()
    joined = e.join(fields, "cluster_id")
    return joined.select("job_id", "id", *[F.try_element_at("canonical_fields", F.lit(f)).alias(f) for f in ("name", "phone", "email", "address")])


def p8_pack(spark: SparkSession, root: str) -> DataFrame:
    """Every document's pieces with their container of 2,048 tokens."""
    return pack(count_tokens(read_table(spark, root, "documents")), 2048)


def p8_pack_512(spark: SparkSession, root: str) -> DataFrame:
    """Every document's pieces with their container of 512 tokens."""
    return pack(count_tokens(read_table(spark, root, "documents")), 512)


def p8_quality(spark: SparkSession, root: str) -> DataFrame:
    """Containers used and room left unused, for both capacities."""
    tokens = count_tokens(read_table(spark, root, "documents"))
    rows = [packing_quality(pack(tokens, c), c).withColumn("capacity", F.lit(c)) for c in (512, 2048)]
    return rows[0].unionByName(rows[1])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of customers whose names mean the same person or organisation."""
    return linked_pairs(resolve_names(read_table(spark, root, "customers")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of customers and sites whose addresses denote the same location."""
    tables = [read_table(spark, root, t).select(F.col("id").alias("record_id"), "address", "city", "zip") for t in ("customers", "sites")]
    return located_pairs(resolve_addresses(tables[0].unionByName(tables[1])))


def p1_places(spark: SparkSession, root: str) -> DataFrame:
    """Every customer and site with a location, with that location's key: the form that stays small where a place has many records."""
    tables = [read_table(spark, root, t).select(F.col("id").alias("record_id"), "address", "city", "zip") for t in ("customers", "sites")]
    r = resolve_addresses(tables[0].unionByName(tables[1]))
    return r.select("record_id", location_key(F.col("house"), F.col("unit"), F.col("many_units")).alias("place")).distinct()


def p3_entities(spark: SparkSession, root: str) -> DataFrame:
    """Every customer with a name that means somebody, with the key of whom it means."""
    return resolve_names(read_table(spark, root, "customers")).select("record_id", "entity").distinct()


QUERIES = {"p1_found": p1_found, "p1_places": p1_places, "p3_found": p3_found, "p3_entities": p3_entities, "p8_pack": p8_pack, "p8_pack_512": p8_pack_512, "p8_quality": p8_quality, "p5_found": p5_found, "p5_retained": p5_retained, "p5_canonical": p5_canonical, "p7_found": p7_found, "p9_found": p9_found, "p10_found": p10_found, "p10_rates": p10_rates}

#: The value to keep, stated plainly: the usable one of the latest time.
_SURVIVORS = r"""
with m as (select distinct cluster_id, record_id, updated_at, name, phone, email, address from cluster_members),
l as (select cluster_id, record_id, updated_at, u.f field_name, u.v as value from (select *, unnest([{'f': 'name', 'v': name}, {'f': 'phone', 'v': phone}, {'f': 'email', 'v': email}, {'f': 'address', 'v': address}]) u from m) where trim(u.v) <> ''),
d as (select *, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) p, regexp_replace(regexp_replace(value, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\1') g, regexp_matches(value, '[\x{FFFD}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{80}-\x{9F}]') damaged from l),
e as (select *, case when field_name = 'phone' and length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 then g else p end fact,
  case field_name when 'phone' then regexp_matches(g, '^[2-9][0-9]{2}[2-9][0-9]{6}$') and regexp_matches(value, '^[+]?[0-9(][0-9 ().\-/]*$') and replace(g, left(g, 1), '') <> ''
   when 'email' then regexp_matches(p, '^[a-z0-9][a-z0-9._%+-]*@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9-]+)*\.[a-z]{2,}$') and not contains(p, '..')
   when 'address' then regexp_matches(p, '[0-9]') and regexp_matches(p, '\p{L}{2,}') else regexp_matches(p, '\p{L}{2,}') end and not damaged and p not in (FILLERS) form from d),
fc as (select distinct cluster_id, field_name, fact from e),
og as (select cluster_id, field_name, min(left(fact, 2)) lo, max(left(fact, 2)) hi from e where form group by all),
shared as (select field_name, fact from fc left join og using (cluster_id, field_name) group by all having count(*) >= 12 and avg(coalesce(lo <> left(fact, 2) or hi <> left(fact, 2), false)::int) >= 0.8),
u as (select * from e where form and (field_name, fact) not in (select field_name, fact from shared)
  and not exists (select 1 from e o where o.cluster_id = e.cluster_id and o.field_name = e.field_name and not o.damaged and length(o.fact) > length(e.fact) and contains(o.fact, e.fact))),
b as (select cluster_id, field_name, arg_max(value, (coalesce(updated_at, timestamptz '0001-01-01'), value)) v from u group by all)
select cluster_id, field_name, min(record_id) as record_id from u join b using (cluster_id, field_name) where value = v group by all""".replace("FILLERS", ", ".join(f"'{x}'" for x in FILLERS))

SQL: dict[str, str] = {
    "p5_found": _SURVIVORS,
    "p5_canonical": _SURVIVORS[: _SURVIVORS.rindex("select cluster_id, field_name, min(record_id)")] + """
select job_id, id, max(v) filter (where field_name = 'name') as name, max(v) filter (where field_name = 'phone') as phone, max(v) filter (where field_name = 'email') as email, max(v) filter (where field_name = 'address') as address
from (select distinct job_id, id, cluster_id from resolved_entities where entity_type = 'customer') join b using (cluster_id) group by all""",
    "p7_found": """
with recursive edge as (
  select left_id a, right_id b from match_pairs where is_match and trim(left_id) <> '' and trim(right_id) <> ''
  union select right_id, left_id from match_pairs where is_match and trim(left_id) <> '' and trim(right_id) <> ''
), reach(record_id, other) as (
  select a, a from edge union select r.record_id, e.b from reach r join edge e on e.a = r.other
)
select record_id, min(other) as group_id from reach group by record_id""",
}
