"""Rules on values, readers, code mapping and resolution of the migration pipeline."""

import random

import pytest

import __spark_entry__ as entry
from drayline.functions import scalars as S
from drayline.functions.service_codes import map_service_code
from drayline.operators import migrate as M
from drayline.operators import report as R
from drayline.operators.entities import confidence_histogram, entity_page, entity_view, has_output, trailing_counts, with_first_of
from drayline.operators.normalize import flag_rows, normalize_records
from drayline.operators.resolve import block_customers, cluster_labels, customer_clusters, similar_pairs
from drayline.sources import legacy
from drayline.queries.migration import FIELDS
from drayline.sources.legacy import csv_cells, fixed_text, read_lines, read_rows, unique_headers, wide_cells
from drayline.streaming.intake import stream_intake
from pyspark.sql import functions as F


def one(spark, rule, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.x for r in df.select(rule(F.col("v")).alias("x")).collect()]


def test_dates(spark):
    got = one(spark, S.normalize_date, "2020-2-29", "5-Mar-69", "5-mar-70", "02/30/2020", "3/4/2020", "3/4/20", "x", "", None, "5-Foo-20")
    assert [tuple(g) for g in got] == [("2020-02-29", False, None), ("2069-03-05", False, None), ("1970-03-05", False, None), (None, False, "invalid date"), ("2020-03-04", False, None), (None, True, "ambiguous 2-digit year"), (None, True, "unrecognized format"), (None, False, "empty"), (None, False, "empty"), (None, False, "invalid month name")]


def test_phones_ids_names_and_money(spark):
    assert one(spark, S.normalize_phone, "(327) 555-0100", "+1 327 555 0100", "911 555 0100", "327 911 0100", "5550100", None) == ["+13275550100", "+13275550100", None, None, None, None]
    assert one(spark, S.normalize_container_id, " rc-0012", "bin 7", "000", "CONTAINER-5", "x  9", None) == ["RC-12", "RC-7", "RC-0", "RC-5", "X 9", None]
    assert one(spark, S.normalize_company_name, "acme  hauling, l.l.c.", "SMITH-JONES co", "Ltd", "llc", "Acme Waste.", "Acme,  Inc.", "", None) == ["Acme Hauling LLC", "Smith-Jones Co", "Ltd", "LLC", "Acme Waste.", "Acme Inc", "", None]
    assert one(spark, S.cents_of, "$1,234.5", "-7", "1.234", "", None) == [123450, -700, None, None, None]
    assert one(spark, S.phonetic_key, "Summit Waste LLC", "St. Clair") == ["SSMM", "SST."]
    assert one(spark, S.fnv1a, "", "a", "foobar") == ["811c9dc5", "e40c292c", "bf9cf968"]


@pytest.mark.parametrize(
    ("code", "lob", "size", "frequency", "confidence"),
    [
        ("SW-RO-20YD", "rolloff", 20, "weekly", 1.0), ("SW-RO-20", "rolloff", 20, "weekly", 0.9), ("sw-fl-6yd", "frontload", 6, "weekly", 0.92), ("SW-RES-1-BW", "residential", 1, "biweekly", 1.0), ("SW-COMM-XX", "frontload", None, None, 0.2),
        ("SW-OPEN-20YD", "rolloff", 20, "weekly", 0.6), ("SW-COMM-2 YD", "frontload", 2, None, 0.45), ("SW-XX-99YD", None, 99, None, 0.3), ("??", None, None, None, 0.3),
        ("SW-RES-2", "residential", 2, None, 0.6), ("SW-RO-20YD-ZZ", "rolloff", 20, "weekly", 0.6), ("SW-ROLLOFF-20", "rolloff", 20, "weekly", 0.92), ("SW-COMM", "frontload", None, None, 0.5), ("SW-RES-3-Q", "residential", 3, None, 0.2),
    ],
)
def test_service_codes(spark, code, lob, size, frequency, confidence):
    m = one(spark, map_service_code, code)[0]
    assert (m.lob, m.size_yards, m.frequency, m.confidence) == (lob, size, frequency, confidence)


def test_notes_of_service_codes(spark):
    got = [m.notes for m in one(spark, map_service_code, "SW-COMM-XX", "SW-RO-25", "SW-RES-1YD", "SW-OPEN-07YD", "SW-XX-99YD", "Bin RO", "12")]
    assert got == [
        ["Missing container size.", 'Unknown frequency token "XX".'], ["Size 25 yards is outside the 10/20/30/40 yard sizes offered for rolloff.", "Missing YD suffix."], ["Residential codes require an explicit frequency token."],
        ["Open-top service is retired in the target model; migrate to the rolloff equivalent."], ['Unknown line-of-business token "XX".', "Parsed size 99 yards, but the line of business is unknown."],
        ['Code structure unrecognized; inferred line of business from token "RO".', "Missing container size."], ["Parsed size 12 yards, unverified.", "No recognizable line-of-business token; manual mapping required."],
    ]
    assert one(spark, map_service_code, "SW-OPEN-07YD")[0].retired_as == "SW-RO-7YD"


def score(spark, a, b):
    rows = spark.createDataFrame([(*a, *b)], ", ".join(f"{s}{f} string" for s in "ab" for f in ("name", "phone", "address", "email")))
    sides = rows.select(*[S.comparable(*[F.col(f"{s}{f}") for f in ("name", "phone", "address", "email")]).alias(s) for s in "ab"])
    return sides.select(S.customer_similarity("a", "b").alias("x")).first().x


def test_similarity_of_customers(spark):
    assert score(spark, ("Acme Hauling LLC", "3275550100", "1 Oak St Dayton", None), ("Acme Hauling Inc", "(327) 555-0100", "Dayton 1 Oak Street", "x@y.example")) == 0.9
    assert score(spark, ("Acme", "3275550100", "", None), ("ACME", "3275550100", None, "")) == 0.9
    assert score(spark, ("Acme", "3275550100", "1 Oak St", "A@x.example "), ("Acme", "3275550100", "1 Oak St", "a@X.example")) == 1.0
    # a third of the words, and one of six letters of the names
    assert score(spark, ("Abcdef", None, "1 Oak St", None), ("Abcdeg", None, "1 Elm Rd", None)) == round(0.31 * 5 / 6 + 0.34 / 5, 6)


def test_records_get_flags(spark):
    df = spark.createDataFrame([("1", "acme co", "5550100", "3/4/20", "bin 7", "12.5", "z"), ("2", None, "", None, "??", "x", "z")], "id string, n string, p string, d string, c string, m string, flags string")
    rows = normalize_records(df, "id", {"name": "n", "phone": "p", "date": "d", "containerId": "c", "amount": "m"})
    got = {(r.record_id, r.field): r.note for r in flag_rows(rows).collect()}
    assert got == {("1", "phone"): "not E.164", ("1", "date"): "ambiguous 2-digit year", ("2", "containerId"): "unrecognized container id", ("2", "amount"): "invalid money"}
    first = rows.where("record_id = '1'").first()
    assert (first.name, first.containerId, first.amount, first.entity_type) == ("Acme Co", "RC-7", "1250", "customer")


def test_cells(spark):
    assert one(spark, csv_cells, 'a,"b,c",d', '"x ""y""",z', 'm"id,dle"x,1', '"open,1') == [["a", "b,c", "d"], ['x "y"', "z"], ["mid,dlex", "1"], ["open,1"]]
    assert one(spark, wide_cells, 'a  "b c" \t d', "a    ") == [["a", "b c", "d"], ["a"]]
    df = spark.createDataFrame([(["A", " a ", "", "B"],)], "h array<string>")
    assert df.select(unique_headers(F.col("h")).alias("x")).first().x == ["A", "B"]
    text = spark.createDataFrame([("n", "s")], "a string, b string").select(fixed_text([F.col("a"), F.col("b"), *[F.lit(None).cast("string")] * 4]).alias("x")).first().x
    assert len(text) == 96 and text.startswith("n ") and text[24] == "s"


def test_files_are_read_with_quarantine(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b"code,name,amount\r\n\r\n1,\"A, B\",5\r\nTotal,x,9\r\n,x,1\r\n2,short\r\n")
    rows = read_rows(read_lines(spark, str(tmp_path / "q.csv")), "quickbooks-export").orderBy("row").collect()
    assert [(r.row, r.error) for r in rows] == [(1, None), (4, "expected 3 columns, got 2")] and rows[0]["values"] == {"code": "1", "name": "A, B", "amount": "5"}
    (tmp_path / "t.txt").write_text("ticket: date:  yard:\n# note\nT1  2020-01-01  East Pit\nT2  2020\n")
    rows = read_rows(read_lines(spark, str(tmp_path / "t.txt")), "transfer-spreadsheet").orderBy("row").collect()
    assert [(r.row, r.error is None) for r in rows] == [(3, True), (4, False)]
    (tmp_path / "l.txt").write_text("key\n" + "Acme".ljust(24) + "swap\n" + "x" * 97 + "\n")
    rows = read_rows(read_lines(spark, str(tmp_path / "l.txt")), "legacy-export").orderBy("row").collect()
    assert rows[0]["values"]["name"] == "Acme" and rows[0]["values"]["service"] == "swap" and rows[1].error


CUSTOMER = "id string, name string, phone string, address string, email string"


def test_clusters(spark):
    rows = [("1", "Acme Hauling LLC", "3275550100", "1 Oak Street", "a@x.example"), ("2", "ACME HAULING", "(327) 555-0100", "1 Oak St", None), ("3", "Zeta", None, None, None), ("3", "Zeta", None, None, None), ("4", None, None, None, None), ("5", None, "", " ", "")]
    got = {r.cluster_id: r for r in customer_clusters(spark.createDataFrame(rows, CUSTOMER)).collect()}
    assert set(got) == {"1", "3", "4"} and got["1"].members == 2 and got["1"].canonical_id == "1" and got["1"].merged and got["1"].addresses == 1 and got["1"].shown == ["1 OAK ST"]
    # records without a name, phone and address are as alike as any others of one block
    assert (got["4"].members, got["4"].confidence, got["4"].merged, got["4"].review) == (2, 0.65, False, True)
    pairs = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(200)], "left_id string, right_id string")
    assert {r.cluster_id for r in cluster_labels(pairs).collect()} == {"000"}
    assert customer_clusters(spark.createDataFrame([], CUSTOMER)).count() == 0


def test_an_address_that_is_empty_is_one_of_a_cluster(spark):
    rows = [("1", "Acme", "3275550100", "1 Oak St", None), ("2", "Acme", "3275550100", "", None)]
    got = customer_clusters(spark.createDataFrame(rows, CUSTOMER)).collect()
    assert [(r.cluster_id, r.addresses, r.shown, r.confidence) for r in got] == [("1", 2, ["1 OAK ST", ""], 0.56)]


def test_blocks_without_a_phone_lose_no_pair(spark):
    rng = random.Random(3)
    words = ["oak", "elm", "st", "rd", "dayton", "1", "2", "3"]
    rows = [(f"{k:03d}", rng.choice(["Acme Hauling", "Acmehauling", "Acm Hauling"]), rng.choice([None, None, "3275550100"]), " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice([None, "a@x.example"])) for k in range(150)]
    blocked = block_customers(spark.createDataFrame(rows, CUSTOMER))
    got = {(r.left_id, r.right_id) for r in similar_pairs(blocked).collect()}
    every = blocked.select("block", F.col("id").alias("x"), F.col("fields").alias("a")).join(blocked.select("block", F.col("id").alias("y"), F.col("fields").alias("b")), "block").where("x < y")
    assert got == {(r.x, r.y) for r in every.where(S.customer_similarity("a", "b") >= 0.5).collect()} and got


def test_a_migration_is_stored_and_can_be_repeated(spark, tmp_path):
    customers = spark.createDataFrame([("1", "acme co", "3275550100"), ("2", "ACME Co.", "327-555-0100"), ("3", "", "x")], "id string, name string, phone string")
    agreements = spark.createDataFrame([("7", "SW-RO-20YD", "1/2/2020"), ("8", "SW-OPEN-20", None), ("9", None, "1/2/20"), ("7", "SW-RO-20YD", "1/2/2020")], "id string, code string, d string")
    records = M.normalized_records(customers, "id", {"name": "name", "phone": "phone"}).unionByName(M.normalized_records(agreements, "id", {"serviceCode": "code", "startDate": "d"}))
    for _ in range(2):
        stored = M.run_migration(records, "j", str(tmp_path / "out"))
    entities = {r.id: r for r in stored["resolved_entities"].collect()}
    assert set(entities) == {"c-n-1", "e-n-3", "e-n-7", "e-n-8", "e-n-9"} and entities["c-n-1"].merged and entities["c-n-1"].canonical_fields == {"id": "n-2", "name": "Acme Co", "phone": "+13275550100", "address": ""}
    assert {(r.id, r.confidence, r.status, r.job_id) for r in stored["proposals"].collect()} == {("p-e-n-7", 1.0, "proposed", "j"), ("p-e-n-8", 0.6, "proposed", "j")}
    x = {r.id: r for r in stored["exceptions"].collect()}
    assert {i: (r.exception_type, r.resolved_entity_id, r.source_record) for i, r in x.items()} == {"exc-map-e-n-8": ("low_mapping_confidence", "e-n-8", "e-n-8")}
    assert x["exc-map-e-n-8"].summary == 'Retired service code "SW-OPEN-20" maps to "SW-RO-20YD"; human confirmation required'
    events = stored["audit_events"].withColumn("d", M.describe_event(F.col("type"), F.col("payload"))).collect()
    assert {r.type: (r.d.message, r.d.level) for r in events} == {
        "CustomerResolved": ("Resolved 5 entities. 1 auto-merged, 0 need review.", "info"), "JobCompleted": ("Job completed. 0 proposals, 1 exceptions.", "info"), "ExceptionRaised": ("Exception raised: low_mapping_confidence (info).", "info"),
    }


def test_exceptions_of_agreements_without_a_code(spark):
    e = spark.createDataFrame([("a", "agreement", {"serviceCode": ""}), ("b", "agreement", {}), ("c", "site", {}), ("d", "site", {"serviceCode": "???"}), ("e", "site", {"serviceCode": " "})], "id string, entity_type string, canonical_fields map<string,string>")
    assert {(r.id, r.exception_type, tuple(r.evidence)) for r in M.mapping_exceptions(e).collect()} == {("exc-map-a", "missing_service_code", ("a",)), ("exc-map-b", "missing_service_code", ("b",)), ("exc-map-d", "low_mapping_confidence", ("d", "???"))}
    assert {(r.id, r.exception_type, tuple(r.evidence)) for r in M.plain_mapping_exceptions(e).collect()} == {("exc-d", "low_mapping_confidence", ("???", "0.3")), ("exc-a", "unmapped_service_code", ("",)), ("exc-e", "unmapped_service_code", (" ",))}


def test_empty_tables_nulls_and_further_columns(spark):
    none = spark.createDataFrame([], "id string, entity_type string, fields map<string,string>, flags array<struct<field:string,note:string>>")
    assert M.resolve_entities(none).count() == 0 and M.normalize_events(none).count() == 0
    entities = spark.createDataFrame([], "job_id string, id string, entity_type string, canonical_fields map<string,string>, confidence double, code string, m string")
    assert M.propose_mappings(entities).count() == 0 and M.mapping_exceptions(entities).count() == 0 and M.plain_mapping_exceptions(entities).count() == 0
    assert M.valid_count(M.propose_mappings(entities), M.mapping_exceptions(entities)).first().valid == 0
    sourced = spark.createDataFrame([], "source string, confidence double")
    assert R.breakdown(sourced, sourced, sourced, "source").count() == 0 and R.summary(sourced, sourced, sourced).first()[:] == (0, 0, 0, 0.0, 0.0)
    lines = R.report_lines(R.summary(sourced, sourced, sourced), R.breakdown(sourced, sourced, sourced, "source"), R.breakdown(sourced.withColumn("entity_type", F.lit("x")), sourced.withColumn("entity_type", F.lit("x")), sourced.withColumn("entity_type", F.lit("x")), "entity_type"), confidence_histogram(sourced))
    assert lines.groupBy("section").count().count() == 4
    empty_lines = spark.createDataFrame([], "source_file string, line_no long, line string, row string, kind string")
    assert legacy.intake(empty_lines, spark.createDataFrame([], "source_file string, kind string")).count() == 0
    assert trailing_counts(spark.createDataFrame([], "k string, at timestamp"), "k", "at", 5).count() == 0
    records = spark.createDataFrame([("r1", "customer", {"name": "x" * 20_000, "phone": None}), ("r2", None, None), (None, "site", {})], "id string, entity_type string, fields map<string,string>")
    got = M.resolve_entities(records).collect()
    assert {(r.id, r.entity_type, tuple(sorted(r.canonical_fields))) for r in got} == {("c-r1", "customer", ("address", "id", "name", "phone")), ("e-r2", "unknown", ())}
    odd = R.breakdown(*[spark.createDataFrame([(None, 0.5), ("a", None)], "source string, confidence double")] * 3, "source").collect()
    assert {(r.source, r.total, r.auto_mapped, r.exceptions, r.avg_confidence) for r in odd} == {(None, 1, 1, 1, 0.5), ("a", 1, 1, 1, 0.0)}


def test_views_of_entities(spark):
    e = spark.createDataFrame([("j", "e1", "site", 0.5), ("j", "e2", "site", 0.5), ("k", "e3", "site", 0.5)], "job_id string, id string, entity_type string, confidence double")
    p = spark.createDataFrame([("j", "e1", 0.9, "m")], "job_id string, resolved_entity_id string, confidence double, mapped_fields string")
    x = spark.createDataFrame([("j", "e1", f"x{k}", "t", "info", "s", ["a"], "f", 0.1, "open", at) for k, at in ((1, 5), (2, 3), (3, 3), (3, 3))], "job_id string, resolved_entity_id string, id string, exception_type string, severity string, summary string, evidence array<string>, suggested_fix string, confidence double, review_status string, created_at long")
    got = {r.id: (r.confidence, [v.id for v in r.exceptions]) for r in entity_view(entity_page(e, job="j", entity_type="site"), p, x).collect()}
    assert got == {"e1": (0.9, ["x2", "x3", "x1"]), "e2": (0.5, [])}
    assert has_output(e, "k") and not has_output(e, "z")
    assert with_first_of(e.select("id"), "id", "n").count() == 3 and [r.id for r in with_first_of(e.select("id").limit(0), "id", "n").collect()] == ["n"]


def test_evaluation(spark):
    cases = [
        ("1", "customer", {"name": "Summit Construction LLC", "phone": "313-555-0123", "address": "100 Main Street"}, {"blockingKey": "SSMM|+13135550123|100 MAIN ST"}), ("2", "site", {"name": "North Depot", "address": "1200 Maple Road", "zip": "48103"}, {"name": "NORTH DEPOT", "address": "1200 MAPLE RD", "zip": "48103"}),
        ("3", "container", {"containerId": "BIN 1023"}, {"containerId": "RC-1023"}), ("4", "agreement", {"serviceCode": "SW-OPEN-30YD"}, {"lineOfBusiness": "rolloff", "sizeYards": "30", "retired": "true"}), ("5", "route", {"name": "Loop"}, {"name": "LOOP", "stops": ""}),
        ("6", "ticket", {"containerId": "1", "date": "01/15/2023"}, {"containerId": "RC-1", "date": "2023-01-15"}), ("7", "agreement", {"serviceCode": "SW-COMM-2YD"}, {"lineOfBusiness": "rolloff"}), ("8", "other", {}, {}), ("9", "agreement", {}, {"frequency": "weekly"}),
    ]
    results = R.run_cases(spark.createDataFrame(cases, "id string, entity_type string, input map<string,string>, expected map<string,string>")).cache()
    assert {r.id: (r.passed, r.confidence) for r in results.collect()} == {"1": (True, 1.0), "2": (True, 1.0), "3": (True, 1.0), "4": (True, 0.6), "5": (True, 1.0), "6": (True, 1.0), "7": (False, 1.0), "8": (True, 0.0), "9": (False, 0.0)}
    e = R.evaluation(results).first()
    assert (e.total, e.auto_mapped, e.silent_errors, e.exceptions, e.passes_gate) == (9, 5, 1, 3, False)
    assert R.evaluation(results.where("id in ('1', '2')")).first().passes_gate and R.evaluation(results.limit(0)).first().total == 0
    assert {r.bucket: (r.n, round(r.accuracy, 4)) for r in R.calibration(results.where("id <> '8'")).collect()} == {9: (6, 0.8333), 6: (1, 1.0), 0: (1, 0.0)}


def test_values_as_people_see_them(spark):
    assert one(spark, S.shown_cents, "123405", "", None, "x", "-5") == ["$1,234.05", "", "", "x", "$-0.05"]
    assert one(spark, S.exception_label, "orphan_container", "new_kind", None) == ["No site assigned", "new kind", None]
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("", "9.9.9.9"), (None, None)], "a string, b string")
    assert [r.x for r in df.select(S.first_address(F.col("a"), F.col("b")).alias("x")).collect()] == ["1.1.1.1", "9.9.9.9", "unknown"]
    assert spark.range(1).select(S.mapped_text(F.lit("rolloff"), F.lit(20)).alias("a"), S.mapped_text(F.lit(None), F.lit(20)).alias("b"), S.percent(F.lit(0.125)).alias("c"), S.multiply_cents(F.lit(5), F.lit(0.5)).alias("d"), S.location_text(F.lit("x"), F.lit(""), F.lit("1")).alias("e")).first()[:] == ("rolloff (20yd)", "Not mapped", "12.5%", 3, "x, 1")


def test_files_in_many_splits_keep_their_line_numbers(spark, tmp_path):
    text = "".join(f"line {k} {'x' * (k % 50)}\r\n" for k in range(1, 3001))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_text("one\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert rows.rdd.getNumPartitions() > 4
        got = {(r.source_file.rsplit("/", 1)[1], r.line_no): r.line for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3002 and all(got[("a.txt", k)] == f"line {k} {'x' * (k % 50)}" for k in range(1, 3001)) and got[("b.txt", 2)] == "two"


def test_intake_quarantines_rows_and_files(spark, monkeypatch):
    monkeypatch.setattr(legacy, "LINES_PER_PART", 2)
    lines = [("c", 1, "id,name"), ("c", 2, ""), ("c", 3, '1,"a,b"'), ("c", 4, "2"), ("c", 5, "3,c"), ("c", 5, "3,c"), ("e", 1, ""), ("u", 1, "x"), ("t", 1, " # note"), ("t", 2, 'id: "two words": n:'), ("t", 3, 'a  "b c"  d')]
    files = [("c", "routepro-csv"), ("e", "legacy-export"), ("u", "fax"), ("t", "transfer-spreadsheet"), ("z", "routepro-csv")]
    got = legacy.intake(spark.createDataFrame(lines, "source_file string, line_no long, line string"), spark.createDataFrame(files, "source_file string, kind string")).collect()
    rows = {r.id: (r["values"], r.error) for r in got}
    assert rows == {
        "c:1": ({"id": "1", "name": "a,b"}, None), "c:2": (None, "expected 2 columns, got 1"), "c:3": ({"id": "3", "name": "c"}, None), "e:0": (None, "source file has no content to parse"),
        "u:0": (None, "Unknown source kind: fax"), "z:0": (None, "source file has no content to parse"), "t:3": ({"id": "a", "two words": "b c", "n": "d"}, None),
    }
    by_hand = 2166136261
    for c in 'c:1:{"id":"1","name":"a,b"}':
        by_hand = (by_hand ^ ord(c)) * 16777619 & 0xFFFFFFFF
    assert next(r.raw_hash for r in got if r.id == "c:1") == f"{by_hand:08x}" and len(got) == len(rows)


def test_files_are_written_as_they_are_read(spark):
    rows = spark.createDataFrame([(1, "a", 'x "y", z'), (2, None, "b c")], "place long, id string, name string")
    for kind, names in (("routepro-csv", ["id", "name"]), ("transfer-spreadsheet", ["id", "name"])):
        lines = legacy.file_lines(rows.na.fill("n"), kind, names, "place").withColumn("source_file", F.lit("f"))
        back = {r.row: r["values"] for r in read_rows(lines, kind).collect()}
        assert [back[k]["id"] for k in sorted(back)] == ["a", "n"]
    fixed = legacy.file_lines(rows, "legacy-export", [], "place").orderBy("line_no").collect()
    assert fixed[0].line.startswith("NAME/SERVICE") and all(len(r.line) == 96 for r in fixed[1:])


def test_row_counts_skip_headers_keys_and_notes(spark):
    lines = [("a.csv", "h"), ("a.csv", "1"), ("a.csv", "  # x"), ("a.csv", "Total 5"), ("a.csv", " "), ("legacy.txt", "NAME/SERVICE/X"), ("legacy.txt", "r"), ("legacy.txt", "name/service"), ("empty.csv", "")]
    got = {r.file_name: r.records for r in legacy.row_counts(spark.createDataFrame(lines, "file_name string, line string")).collect()}
    assert got == {"a.csv": 1, "legacy.txt": 1, "empty.csv": 0}


def test_pages_and_histograms(spark):
    e = spark.createDataFrame([(f"e{k:03d}", k / 250) for k in range(251)], "id string, confidence double")
    first = entity_page(e).collect()
    assert len(first) == 101 and entity_page(e, first[99].id).first().id == first[100].id
    buckets = {r.bucket: r.n for r in confidence_histogram(e).collect()}
    assert len(buckets) == 10 and sum(buckets.values()) == 251 and buckets[9] == 26
    assert {r.n for r in confidence_histogram(e.limit(0)).collect()} == {0}


def test_trailing_counts(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.randrange(0, 400)) for k in range(300)] + [(300, "a", 100), (301, "a", 100), (302, "a", None), (303, "a", None)]
    df = spark.createDataFrame(rows, "id int, key string, at int").withColumn("at", F.timestamp_seconds("at"))
    got = {r.id: r.trailing for r in trailing_counts(df, "key", "at", 50).collect()}
    assert got == {i: sum(q == k and ((t is None) == (u is None)) and (t is None or t - 50 <= u <= t) for _, q, u in rows) for i, k, t in rows}


def test_intake_as_a_stream(spark, tmp_path):
    lines = spark.createDataFrame([("F", 1, "h"), ("F", 2, "a,1"), ("F", 3, "a,x")], "source_file_id string, line_no long, line string")
    lines.write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([("F", "routepro-csv")], "id string, kind string")
    columns = spark.createDataFrame([("routepro-csv", 1, "n", "text", True, None), ("routepro-csv", 2, "v", "integer", True, None)], "kind string, pos int, column_name string, value_type string, required boolean, width int")
    stream_intake(spark, str(tmp_path / "in"), files, columns, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/valid")).count() == 1 and spark.read.parquet(str(tmp_path / "out/rejected")).first().error == "invalid_value"


def test_queries_cover_whole_lines_and_all_fields(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    save("raw_lines", [("f", 1, 'a,"b,c",,"d ""e""",g')], "source_file_id string, line_no int, line string")
    save("source_files", [("f", "routepro-csv")], "id string, kind string")
    save("customers", [("c", "Acme", "12", *[None] * 5)], "id string, name string, phone string, address string, email string, city string, state string, zip string")
    for name, columns in FIELDS.items():
        if name != "customers":
            row = {"sites": {"name": "Acme"}, "containers": {"id": "RC-1"}, "agreements": {"start_date": "2020-01-02", "end_date": "nonsense", "container_id": "RC-1", "rate_cents": "much"}}[name]
            names = sorted({*columns.values(), "id"})
            save(name, [tuple(row.get(c) for c in names)], ", ".join(f"{c} string" for c in names))
    assert [r.rewritten for r in entry.queries()["csv_cells_of_lines"](spark, str(tmp_path)).collect()] == ['a,"b,c",,"d ""e""",g']
    got = {(r.table_name, r.field, r.n) for r in entry.queries()["flags_of_records"](spark, str(tmp_path)).collect()}
    assert got == {("customers", "phone", 1), ("agreements", "endDate", 1), ("agreements", "rateCents", 1)}


def test_every_query_has_a_name_and_sql_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 20
