"""Parse failures, timestamps and orphan references, against plain versions and in odd cases."""

import csv
import datetime as dt
import io
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pyarrow as pa
from drayline.operators.orphans import classify_references, number_key, orphan_report, parents, plain_key, references
from drayline.operators.parse_rows import ColumnSpec, parse_lines, parse_rows
from drayline.operators.timestamps import fit_notations, infer_orders, normalize_timestamps
from pyspark.sql import functions as F

SPEC = [ColumnSpec("a", "text", True), ColumnSpec("b", "integer", False), ColumnSpec("c", "date_ymd", True)]
SYSTEMS = "kind string, time_zone string, date_order string"


def reason(line: str) -> str | None:
    return parse_lines(pa.array([line]), "routepro-csv", SPEC)[1][0]


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("x,1,2020-02-29", None), ("x,,2020-02-29", None), ('"a,b",1,2020-01-01', None), ('"say ""hi""",1,2020-01-01\r', None), (" x , 1 , 2020-01-01 ", None),
        ("x,1,2021-02-29", "invalid_value"), ("x,1.5,2020-01-01", "invalid_value"), (",1,2020-01-01", "invalid_value"), ("x,1", "column_count"), ("x,1,2020-01-01,", "column_count"),
        ('"x,1,2020-01-01', "quoting"), ('x"y,1,2020-01-01', "quoting"), ('"x"y,1,2020-01-01', "quoting"), ('"x"y"z",1,2020-01-01', "quoting"), ('462- "555 ",1', "quoting"), ('"",1,2020-01-01', "invalid_value"),
    ],
)
def test_reasons(line, error):
    assert reason(line) == error


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text(alphabet='ab", é1', max_size=6), min_size=3, max_size=3), min_size=1, max_size=6))
def test_written_lines_are_read_back(rows):
    spec = [ColumnSpec(c, "text", False) for c in "abc"]
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    values, errors = parse_lines(pa.array(lines), "routepro-csv", spec)
    assert errors == [None] * len(rows)
    assert values.to_pylist() == rows


def test_blank_runs_and_fixed_width():
    spec = [ColumnSpec("t", "text", True), ColumnSpec("g", "decimal", True), ColumnSpec("y", "text", False)]
    values, errors = parse_lines(pa.array(["TK1 \t2.50   East Pit", 'TK1\t""  x', '"A  B"\t-1\t""', "TK1  1"]), "transfer-spreadsheet", spec)
    assert errors == [None, "invalid_value", None, "column_count"]
    assert values.to_pylist()[0] == ["TK1", "2.50", "East Pit"] and values.to_pylist()[2] == ["A  B", "-1", ""]
    fixed = [ColumnSpec("n", "text", True, 4), ColumnSpec("z", "integer", True, 3)]
    values, errors = parse_lines(pa.array(["Jö  12", "ab  1234", "    1  ", "ab"]), "legacy-export", fixed)
    assert errors == [None, "column_count", "invalid_value", "invalid_value"] and values.to_pylist()[0] == ["Jö", "12"]


def test_parse_rows_in_odd_cases(spark):
    files = spark.createDataFrame([("F", "quickbooks-export"), ("G", "transfer-spreadsheet")], "id string, kind string")
    columns = spark.createDataFrame([("quickbooks-export", 1, "n", "text", True, None), ("quickbooks-export", 2, "v", "integer", False, None), ("transfer-spreadsheet", 1, "t", "text", True, None)], "kind string, pos int, column_name string, value_type string, required boolean, width int")
    rows = [("F", 1, "n,v", "z"), ("F", 2, "x,1", "z"), ("F", 2, "x,1", "z"), ("F", 3, None, "z"), ("F", 4, "  \r", "z"), ("F", 5, "Total,9", "z"), ("F", 6, "reporting,a", "z"), ("G", 2, "# note", "z"), ("G", 3, "T1", "z"), ("?", 2, "a", "z"), ("F", 7, "y" * 200_000 + ",2", "z"), (None, 2, "q", "z"), ("F", None, "q", "z")]
    got = parse_rows(spark.createDataFrame(rows, "source_file_id string, line_no long, line string, kind string"), files, columns).collect()
    assert sorted((r.source_file_id or "", r.line_no or 0, r.error or "") for r in got) == [("", 2, "unknown_kind"), ("?", 2, "unknown_kind"), ("F", 2, ""), ("F", 2, ""), ("F", 6, "invalid_value"), ("F", 7, ""), ("G", 3, "")]
    empty = spark.createDataFrame([], "source_file_id string, line_no long, line string")
    assert parse_rows(empty, files, columns).count() == 0


def instants(spark, values, systems=(("S", "America/Detroit", "mdy"), ("D", "Europe/Berlin", "dmy"))):
    df = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate(values)], "k int, source string, value string").withColumn("time_zone", F.lit("mine"))
    out = normalize_timestamps(df, spark.createDataFrame(list(systems), SYSTEMS))
    return {r.k: (r.status, r.utc_micros) for r in out.collect()}


def micros(*parts, zone="UTC"):
    d = dt.datetime(*parts, tzinfo=ZoneInfo(zone)).astimezone(dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    return d // dt.timedelta(microseconds=1)


def test_notations(spark):
    cases = [
        ("S", "2020-01-02", micros(2020, 1, 2, zone="America/Detroit")), ("S", "03/04/20", micros(2020, 3, 4, zone="America/Detroit")), ("D", "03/04/2020 7:05 PM", micros(2020, 4, 3, 19, 5, zone="Europe/Berlin")),
        ("S", "2020-01-02T03:04:05.25Z", micros(2020, 1, 2, 3, 4, 5, 250000)), ("S", " 2020-01-02 03:04:05 +0545\t", micros(2020, 1, 1, 21, 19, 5)), ("S", "2020-07-02 03:04:05 EDT", micros(2020, 7, 2, 7, 4, 5)),
        ("S", "2020-07-02 03:04:05 America/Detroit", micros(2020, 7, 2, 7, 4, 5)), ("D", "2020-07-02T03:04:05[America/Phoenix]", micros(2020, 7, 2, 10, 4, 5)), ("S", "Sat, 03 Jan 2015 01:53:30 -0500", micros(2015, 1, 3, 6, 53, 30)),
        ("S", "Apr 9, 2024 12:03am", micros(2024, 4, 9, 0, 3, zone="America/Detroit")), ("S", "1-SEP-20", micros(2020, 9, 1, zone="America/Detroit")), ("S", "20200102", micros(2020, 1, 2, zone="America/Detroit")),
        ("S", "1577934245", micros(2020, 1, 2, 3, 4, 5)), ("S", "1577934245123", micros(2020, 1, 2, 3, 4, 5, 123000)), ("S", "42185.5", micros(2015, 6, 30, 12, zone="America/Detroit")), ("S", "03/03/2020", micros(2020, 3, 3, zone="America/Detroit")),
    ]
    got = instants(spark, [(s, v) for s, v, _ in cases])
    assert [got[k] for k in range(len(cases))] == [("resolved", m) for _, _, m in cases]


def test_values_without_one_instant(spark):
    cases = [("S", None), ("S", ""), ("S", "open"), ("S", "2021-02-29"), ("S", "31-Apr-21"), ("S", "00/00/0000"), ("S", "2020-03-08 02:30:00"), ("S", "2020-11-01 01:30:00"), ("S", "2020-01-01T25:10:00Z"), ("S", "25/03/2020"), ("?", "2020-01-01"), ("?", "2020-01-01T00:00:00Z"), (None, "x" * 50_000)]
    got = instants(spark, cases)
    assert [got[k][0] for k in range(len(cases))] == ["no_date", "no_date", "no_date", "impossible", "impossible", "impossible", "no_single_instant", "no_single_instant", "impossible", "impossible", "no_single_instant", "resolved", "no_date"]


def test_undeclared_order_is_learned_or_marked(spark):
    systems = [("A", "UTC", None), ("B", "UTC", None)]
    got = instants(spark, [("A", "25/03/2020")] * 60 + [("A", "04/03/2020"), ("B", "04/03/2020")], systems)
    assert got[60] == ("resolved", micros(2020, 3, 4)) and got[61] == ("ambiguous", None)


def test_a_declared_order_is_a_prior_that_values_can_outweigh(spark):
    got = instants(spark, [("S", "25/03/2020")] * 2000 + [("S", "04/03/2020"), ("D", "04/03/2020")])
    assert got[2000] == ("ambiguous", None) and got[2001][0] == "resolved" and got[0] == ("impossible", None)


def test_abbreviations_are_those_of_the_zone(spark):
    systems = (("D", "America/Chicago", "mdy"), ("S", "Asia/Shanghai", "mdy"), ("X", "nowhere", None))
    got = instants(spark, [("D", "2020-01-02 03:04:05 CST"), ("S", "2020-01-02 03:04:05 CST"), ("S", "2020-01-02 03:04:05 PST"), ("X", "2020-01-02 03:04:05 GMT"), ("X", "2020-01-02 03:04:05 CST")], systems)
    assert [got[k] for k in range(5)] == [("resolved", micros(2020, 1, 2, 9, 4, 5)), ("resolved", micros(2020, 1, 1, 19, 4, 5)), ("no_single_instant", None), ("resolved", micros(2020, 1, 2, 3, 4, 5)), ("no_single_instant", None)]


def test_orders_are_found_without_a_declaration(spark):
    df = spark.createDataFrame([("A", "25/03/2020")] * 40 + [("B", "03/25/2020")] * 40 + [("C", "03/04/2020"), ("D", "x"), ("B", None)], "source string, value string")
    got = {r.source: r.date_order for r in infer_orders(df, spark.createDataFrame([("A", "UTC", "mdy")], SYSTEMS)).collect()}
    assert got == {"A": "dmy", "B": "mdy", "C": None}


def test_mixture_prefers_what_the_source_shows():
    import pandas as pd

    w = fit_notations(pd.DataFrame({"set": [8, 12], "n": [90, 10]}), None)
    assert w[3] > 0.8 and w[2] < 0.1


def test_instants_of_empty_tables(spark):
    none = spark.createDataFrame([], "source string, value string")
    assert normalize_timestamps(none, spark.createDataFrame([], SYSTEMS)).count() == 0


def ts(day):
    return None if day is None else dt.datetime(2020, 1, day)


def judge(spark, refs, targets):
    r = spark.createDataFrame([(k, i, ts(t), "x") for k, i, t in refs], "ref string, id string, t timestamp, key string")
    p = spark.createDataFrame([(k, ts(a), ts(b), "y") for k, a, b in targets], "id string, a timestamp, b timestamp, record_id string")
    return classify_references(references(r, "rel", "tab", F.col("id"), plain_key(F.col("ref")), F.col("t")), parents(p, "rel", plain_key(F.col("id")), F.col("a"), F.col("b")))


def brute(refs, targets):
    def key(k):
        return None if k is None or not k.strip() else k.strip().upper()

    out = []
    for k, i, t in refs:
        if key(k) is None:
            continue
        own = [(a, b) for q, a, b in targets if key(q) == key(k)]
        if not own:
            out.append((i, "missing"))
        elif t is None or any((a is None or a <= t) and (b is None or b > t) and (a is None or b is None or b > a) for a, b in own):
            out.append((i, ""))
        else:
            out.append((i, "deleted" if any(b is not None and b <= t for _, b in own) else "late"))
    return sorted(out)


def test_references_in_odd_cases(spark):
    targets = [("K1", 2, 9), (" k1 ", 12, None), ("K2", 5, None), ("K3", 2, 4), ("K3", 2, 4), ("K4", None, None), (None, 1, None), ("K5", 8, 3)]
    refs = [("k1", "a", 1), ("k1", "b", 2), ("K1 ", "c", 9), ("K1", "d", 13), ("K2", "e", 4), ("K2", "f", 5), ("K3", "g", 4), ("k9", "h", 3), (None, "i", 3), ("  ", "j", 3), ("K2", "k", None), ("K4", "l", 1), ("K2", "e", 4), ("K5", "m", 9), ("z" * 10_000, "n", 1)]
    got = sorted((r.record_id, r.reason or "") for r in judge(spark, refs, targets).collect())
    assert got == brute(refs, targets)
    assert judge(spark, [], targets).count() == 0
    assert {r.reason for r in judge(spark, refs, []).collect()} == {"missing"}
    report = orphan_report(judge(spark, refs, targets)).collect()
    assert sum(r.orphans for r in report) == sum(1 for _, x in brute(refs, targets) if x)


def test_a_hot_key_is_split_and_right(spark):
    refs = [("hot", str(k), k % 28 + 1) for k in range(3000)] + [(f"k{k % 50}", f"o{k}", 5) for k in range(1500)]
    targets = [("HOT", 10, 20)] + [(f"K{k}", k % 9 + 1, None) for k in range(40)]
    assert sorted((r.record_id, r.reason or "") for r in judge(spark, refs, targets).collect()) == brute(refs, targets)


def test_container_numbers(spark):
    values = ["RC-0012", "bin 12", "12", "Bin-12 ", "CONTAINER 12", "0", "", None, "lost"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(number_key(F.col("v")).alias("k"))
    assert [r.k for r in df.collect()] == ["12"] * 5 + ["0", None, None, "T:LOST"]
