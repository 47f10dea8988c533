"""Files of the old systems: lines, headers, cells, and the way back to text.

Every reader keeps rows that it cannot place, with an error, beside the good ones. Lines are numbered by the splits of
their files, so files need not fit into one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.functions.scalars import fnv1a

#: Columns of the fixed-width file and their widths.
LEGACY_COLUMNS = (("name", 24), ("service", 14), ("address", 30), ("route", 8), ("zone", 6), ("contact", 14))
#: Fixed value: how the key line of that file begins.
LEGACY_KEY = "(?i)^NAME/SERVICE"
LEGACY_WIDTH = sum(w for _, w in LEGACY_COLUMNS)
#: Parts of file names that tell the kind of a file; the first that fits decides.
NAME_HINTS = ((("quickbooks", "qb"), "quickbooks-export"), (("transfer", "scale", "weigh"), "transfer-spreadsheet"), (("legacy", "paper"), "legacy-export"))
DEFAULT_KIND = "routepro-csv"
#: Kinds of files, and errors of rows and files.
KINDS = ("routepro-csv", "quickbooks-export", "transfer-spreadsheet", "legacy-export")
LEGACY_TOO_LONG = "row exceeds fixed-width layout"
NO_CONTENT = "source file has no content to parse"
#: Lines whose places are counted together.
LINES_PER_PART = 100_000


def detect_kind(file_name: Column) -> Column:
    """Kind of a file by its name."""
    lower = F.lower(file_name)
    kind = F.lit(DEFAULT_KIND)
    for words, name in reversed(NAME_HINTS):
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        kind = F.when(hit, name).otherwise(kind)
    return kind


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(source_file, line_no, line)`` of text files, carriage returns before line ends removed; numbers start at 1.

    A file is read in splits of any number; each split's lines are counted, and the counts before it are added. What
    follows the last line end is a line only if it isn't empty.
    """
    scanned = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    blocks = scanned.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source_file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("add"))
    return scanned.join(starts, ["source_file", "block"]).select("source_file", (F.col("id") + F.col("add")).alias("line_no"), "line")


def _closed(line: Column) -> Column:
    """With an open quote closed at the end of the line."""
    return F.when(F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line)


def _outside_quotes(line: Column, delimiter: str) -> Column:
    d = re.escape(delimiter)
    plain = f'(?:(?!{d})[^"])*+'
    return F.regexp_extract_all(F.concat(_closed(line), F.lit(delimiter)), F.lit(f'({plain}(?:"[^"]*+"{plain})*+){d}'), F.lit(1))


def csv_cells(line: Column) -> Column:
    """Cells of a comma-separated line; quotes may open anywhere and an open one runs to the end of the line."""
    return F.transform(_outside_quotes(line, ","), lambda c: F.replace(F.regexp_replace(c, '"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"')))


def split_outside_quotes(line: Column, delimiter: str) -> Column:
    """Parts between delimiters that stand outside quotes; all quotes go, doubled ones too."""
    return F.transform(_outside_quotes(line, delimiter), lambda c: F.replace(c, F.lit('"'), F.lit("")))


def wide_cells(line: Column) -> Column:
    """Cells of a line whose columns stand two or more blanks apart; one layer of quotes goes, empty cells are dropped."""
    cells = F.transform(F.split(F.trim(line), "[ \\t]{2,}"), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))
    return F.filter(cells, lambda c: c != "")


def fixed_cells(line: Column) -> Column:
    """Trimmed cells of a fixed-width line; a short line counts as filled up."""
    at, cells = 1, []
    for _, width in LEGACY_COLUMNS:
        cells.append(F.trim(F.substring(line, at, width)))
        at += width
    return F.array(*cells)


def unique_headers(cells: Column) -> Column:
    """Trimmed headers without empty ones and later repeats in any case; cells are not moved along."""
    trimmed = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    lower = F.transform(trimmed, lambda c: F.lower(c))
    return F.filter(trimmed, lambda c, i: F.array_position(lower, F.lower(c)) == i + 1)


def row_map(headers: Column, cells: Column) -> Column:
    """Headers with their trimmed cells; what is missing is empty, what is too much is left out."""
    return F.map_from_entries(F.transform(headers, lambda h, i: F.struct(h, F.coalesce(F.trim(F.get(cells, i)), F.lit("")))))


def _number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``row``, the place of each line among those of its file, from 0; a file may be of any length."""
    part = lines.withColumn("part", F.floor(F.col("line_no") / LINES_PER_PART))
    before = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("source_file", "part").agg(F.count("*").alias("n")).select("source_file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source_file", "part").orderBy("line_no"))
    return part.join(starts, ["source_file", "part"]).withColumn("row", F.col("base") + inside - 1).drop("part", "base")


def read_rows(lines: DataFrame, kind: str) -> DataFrame:
    """``(source_file, row, values, error)`` of the data rows of files of one kind.

    Comma-separated files number the lines that aren't blank, from 0 with the header; the others count physical lines.
    Bookkeeping rows whose first cell is empty or begins with the word total or report are skipped silently.
    """
    text = F.trim("line")
    if kind == "legacy-export":
        data = lines.where((F.col("line_no") > 1) & (text != ""))
        names = F.array(*[F.lit(n) for n, _ in LEGACY_COLUMNS])
        long = F.length("line") > LEGACY_WIDTH
        return data.select("source_file", F.col("line_no").alias("row"), F.when(~long, row_map(names, fixed_cells(F.col("line")))).alias("values"), F.when(long, LEGACY_TOO_LONG).alias("error"))
    if kind == "transfer-spreadsheet":
        kept = lines.where((text != "") & ~text.startswith("#")).withColumn("row", F.col("line_no"))
        cells = wide_cells(F.col("line"))
        headers = F.transform(F.filter(split_outside_quotes(F.col("line"), " "), lambda c: c != ""), lambda c: F.regexp_replace(c, ":$", ""))
    elif kind in ("routepro-csv", "quickbooks-export"):
        kept = _number_lines(lines.where(text != ""))
        cells, headers = csv_cells(F.col("line")), unique_headers(csv_cells(F.col("line")))
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    heads = kept.groupBy("source_file").agg(F.min_by(F.struct("row", headers.alias("headers")), "row").alias("h"))
    rows = kept.join(heads, "source_file").where(F.col("row") > F.col("h.row")).withColumn("cells", cells)
    if kind == "quickbooks-export":
        first = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
        rows = rows.where((first != "") & ~first.rlike(r"(?i)^(total|report)\b"))
    headers = F.col("h.headers")
    error = F.when(F.size(headers) == 0, "no header row").when(F.size("cells") < F.size(headers), F.format_string("expected %d columns, got %d", F.size(headers), F.size("cells")))
    return rows.select("source_file", "row", F.when(error.isNull(), row_map(headers, F.col("cells"))).alias("values"), error.alias("error"))


def intake(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, source_file, row, values, raw_hash, error)`` of all files, whatever their kind: good rows and quarantined ones.

    ``lines`` is as :func:`read_lines` gives it, ``files`` has ``source_file`` and ``kind``; a line counts once. A file without any line, or with one
    empty line only, gets an error at row 0; files of an unknown kind get one too. The hash is over file, row and values.
    """
    known = files.select("source_file", "kind").where("source_file is not null").distinct()
    once = lines.select("source_file", "line_no", "line").distinct()
    parts = [read_rows(once.join(known.where(F.col("kind") == k), "source_file", "left_semi"), k) for k in KINDS]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    full = once.where("line <> '' or line_no > 1").select("source_file").distinct()
    strange = ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    bare = known.join(full.withColumn("full", F.lit(True)), "source_file", "left").where(F.col("full").isNull() | strange)
    nothing = bare.select("source_file", F.lit(0).cast("long").alias("row"), F.lit(None).cast("map<string,string>").alias("values"), F.when(strange, F.concat(F.lit("Unknown source kind: "), F.coalesce("kind", F.lit("")))).otherwise(NO_CONTENT).alias("error"))
    every = rows.withColumn("row", F.col("row").cast("long")).unionByName(nothing)
    name = F.concat_ws(":", "source_file", "row")
    return every.select(name.alias("id"), "source_file", "row", "values", F.when(F.col("error").isNull(), fnv1a(F.concat_ws(":", name, F.to_json("values")))).alias("raw_hash"), "error")


def row_counts(lines: DataFrame) -> DataFrame:
    """Data rows per file, without comments, blank and summary lines, and without the first other line, the header.

    ``lines`` has ``file_name`` too. A file of the legacy system has a key line instead of a header, wherever it stands.
    """
    legacy, text = F.lower("file_name").contains("legacy"), F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    real = (text != "") & ~text.startswith("#") & ~text.rlike(r"(?i)^(total|report)\b") & ~(legacy & text.rlike(LEGACY_KEY))
    counted = lines.groupBy("file_name").agg(F.count_if(real).alias("n"), F.first(legacy).alias("legacy"))
    return counted.select("file_name", F.greatest(F.col("n") - F.when(F.col("legacy"), 0).otherwise(1), F.lit(0)).alias("records"))


def _csv_cell(v: Column) -> Column:
    return F.when(v.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_text(values: list[Column]) -> Column:
    """A comma-separated line; only cells with quotes, commas or line ends are quoted."""
    return F.concat_ws(",", *[_csv_cell(v) for v in values])


def csv_line(cells: Column) -> Column:
    """As :func:`csv_text`, of an array of any number of cells."""
    return F.array_join(F.transform(cells, _csv_cell), ",")


def fixed_text(values: list[Column]) -> Column:
    """A fixed-width line; cells are cut and filled to their widths."""
    return F.concat(*[F.rpad(F.substring(F.coalesce(v, F.lit("")), 1, w), w, " ") for v, (_, w) in zip(values, LEGACY_COLUMNS, strict=True)])


def wide_text(values: list[Column]) -> Column:
    """A line with two blanks between the columns; quoted as comma-separated cells are."""
    return F.concat_ws("  ", *[_csv_cell(v) for v in values])


def header_text(kind: str, names: list[str]) -> str:
    """First line of a file of that kind."""
    if kind == "legacy-export":
        return "/".join(n.upper() for n, _ in LEGACY_COLUMNS)
    if kind == "transfer-spreadsheet":
        return "  ".join(f"{n}:" for n in names) + " "
    return ",".join(names)


def file_lines(rows: DataFrame, kind: str, names: list[str], order: str) -> DataFrame:
    """``(line_no, line)`` of a file of that kind, its header first; ``rows`` has the columns ``names`` and an ``order`` from 1.

    Nulls become empty cells. Of the fixed-width kind the columns are its own, and cells are cut and filled.
    """
    cells = [F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("") for n in ([n for n, _ in LEGACY_COLUMNS] if kind == "legacy-export" else names)]
    line = {"legacy-export": fixed_text, "transfer-spreadsheet": wide_text}.get(kind, csv_text)(cells)
    head = rows.sparkSession.createDataFrame([(1, header_text(kind, names))], "line_no long, line string")
    return head.unionByName(rows.select((F.col(order) + 1).cast("long").alias("line_no"), line.alias("line")))
