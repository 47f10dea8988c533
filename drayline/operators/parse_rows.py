"""Delimited and fixed-width lines into valid rows and reasoned rejects.

Structural indexing: the bytes of a whole Arrow batch form one array; quote masks and their prefix parity tell which
delimiters stand outside quotes, so that value boundaries, column counts and quoting faults of all lines come out of a few
array operations. Value types are checked column by column on the values of all lines at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SPEC_ROWS = 100_000


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    value_type: str
    required: bool
    width: int | None = None


#: How each kind of file separates its values, and which of its lines are no data.
COMMA_KINDS = ("routepro-csv", "quickbooks-export")
BLANK_RUN_KINDS = ("transfer-spreadsheet",)
FIXED_KINDS = ("legacy-export",)
COMMENT_KINDS = ("transfer-spreadsheet",)
SUMMARY_KINDS = ("quickbooks-export",)
_SUMMARY = r"^[ \t\r\"]*(?i:total|report)(?:[^0-9A-Za-z_]|$)"
_TYPES = {"integer": r"^-?[0-9]+$", "decimal": r"^-?[0-9]+(?:\.[0-9]+)?$"}
_QUOTED = r'^"(?:[^"]|"")*"$'

OUT = "source_file_id string, line_no long, kind string, values array<string>, error string"


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as one string array."""
    length = np.maximum(end - begin, 0)
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    index = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data[index].tobytes()))


def _calendar_date(values: pa.Array, year: slice, month: slice, day: slice, shape: str) -> pa.Array:
    """Whether each value is of the shape and a day of the Gregorian calendar."""
    fits = pc.match_substring_regex(values, shape)
    part = [pc.cast(pc.if_else(fits, pc.utf8_slice_codeunits(values, s.start, s.stop), "1"), pa.int32()).to_numpy(zero_copy_only=False) for s in (year, month, day)]
    y, m, d = part
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((m >= 1) & (m <= 12), m, 0)]
    real = (y >= 1) & (d >= 1) & (d <= days + (leap & (m == 2)))
    return pc.and_(fits, pa.array(real))


def _has_type(values: pa.Array, value_type: str) -> pa.Array:
    if value_type in _TYPES:
        return pc.match_substring_regex(values, _TYPES[value_type])
    if value_type == "date_ymd":
        return _calendar_date(values, slice(0, 4), slice(5, 7), slice(8, 10), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    if value_type == "date_mdy":
        return _calendar_date(values, slice(6, 10), slice(0, 2), slice(3, 5), r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$")
    return pa.array(np.ones(len(values), bool))


def _index(lines: pa.Array, commas: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of each line the number of values; all values in order; which lines have a quoting fault."""
    lines = pc.cast(lines, pa.large_string())
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    size = len(data)
    begin, end = offsets[:-1].copy(), offsets[1:].copy()
    blank = (data == 32) | (data == 9)
    dull = blank | (data == 13)
    position = np.arange(size, dtype=np.int64)
    # where the next byte that is content begins, and where the last one before a place ends
    next_full = np.minimum.accumulate(np.where(blank, size, position)[::-1])[::-1] if size else position
    next_full = np.append(next_full, size)
    last_full = np.append(0, np.maximum.accumulate(np.where(blank, 0, position + 1))) if size else np.zeros(1, np.int64)
    last_kept = np.append(0, np.maximum.accumulate(np.where(dull, 0, position + 1))) if size else np.zeros(1, np.int64)
    end = np.maximum(last_kept[end], begin)
    begin = np.minimum(next_full[begin], end)

    quote = data == 34
    quotes_before = np.append(0, np.cumsum(quote))
    line_of = np.repeat(np.arange(n), np.diff(offsets))
    open_at = (quotes_before[:-1] - quotes_before[begin][line_of]) & 1 if size else np.zeros(0, np.int64)
    live = (position >= begin[line_of]) & (position < end[line_of]) if size else np.zeros(0, bool)
    outside = (open_at == 0) & live
    if commas:
        cut_begin = np.flatnonzero((data == 44) & outside)
        cut_end = cut_begin + 1
    else:
        gap = blank & outside
        edge = np.diff(np.concatenate(([0], gap.astype(np.int8), [0])))
        cut_begin, cut_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        tabs = np.append(0, np.cumsum(data == 9))
        wide = (cut_end - cut_begin >= 2) | (tabs[cut_end] > tabs[cut_begin])
        cut_begin, cut_end = cut_begin[wide], cut_end[wide]
    counts = np.bincount(line_of[cut_begin], minlength=n) + 1 if size else np.ones(n, np.int64)
    first = np.append(0, np.cumsum(counts))
    total = int(first[-1])
    starts, stops = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    starts[is_first], starts[~is_first] = begin, cut_end
    stops[is_last], stops[~is_last] = end, cut_begin
    starts = np.minimum(next_full[starts], stops)
    stops = np.maximum(last_full[stops], starts)

    held = quotes_before[stops] - quotes_before[starts]
    values = _gather(data, starts, stops)
    odd = np.flatnonzero(held > 0)
    proper = pc.match_substring_regex(values.take(pa.array(odd)), _QUOTED).to_numpy(zero_copy_only=False) if len(odd) else np.zeros(0, bool)
    line_of_value = np.repeat(np.arange(n), counts)
    fault = np.zeros(n, bool)
    fault[line_of_value[odd[~proper]]] = True
    fault |= ((quotes_before[end] - quotes_before[begin]) & 1).astype(bool)
    inner = np.zeros(total, bool)
    inner[odd[proper]] = True
    starts, stops = starts + inner, stops - inner
    values = _gather(data, starts, stops)
    doubled = np.zeros(total, bool)
    doubled[odd[proper]] = held[odd[proper]] > 2
    if doubled.any():
        values = pc.if_else(pa.array(doubled), pc.replace_substring(values, '""', '"'), values)
    return counts, values, fault


def parse_lines(lines: pa.Array, kind: str, columns: list[ColumnSpec]) -> tuple[pa.Array, list[str | None]]:
    """Values (null for rejects) and the error of each data line of one kind; lines hold no nulls."""
    n, width = len(lines), len(columns)
    if kind in FIXED_KINDS:
        kept = pc.utf8_rtrim(lines, " \t\r")
        total = sum(c.width or 0 for c in columns)
        count_fault = pc.greater(pc.utf8_length(kept), total).to_numpy(zero_copy_only=False)
        quote_fault = np.zeros(n, bool)
        at, table = 0, []
        for c in columns:
            table.append(pc.utf8_trim(pc.utf8_slice_codeunits(kept, at, at + (c.width or 0)), " \t\r"))
            at += c.width or 0
    else:
        counts, flat, quote_fault = _index(lines, kind in COMMA_KINDS)
        count_fault = counts != width
        first = np.append(0, np.cumsum(counts))[:-1]
        good = ~count_fault
        table = [flat.take(pa.array(np.where(good, first + k, 0))) for k in range(width)]
        table = [pc.if_else(pa.array(good), c, "") for c in table]
    bad_value = np.zeros(n, bool)
    for c, values in zip(columns, table, strict=True):
        text = pc.utf8_trim(values, " \t\r")
        empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
        typed = _has_type(text, c.value_type).to_numpy(zero_copy_only=False)
        bad_value |= empty if c.required else np.zeros(n, bool)
        bad_value |= ~empty & ~typed
    error = np.select([quote_fault, count_fault, bad_value], ["quoting", "column_count", "invalid_value"], "")
    ok = np.flatnonzero(error == "")
    lengths = np.zeros(n + 1, np.int64)
    lengths[ok + 1] = width
    offsets = np.cumsum(lengths).astype(np.int32)
    if len(ok) and width:
        picked = [pc.cast(c, pa.string()).take(pa.array(ok)) for c in table]
        order = (np.arange(len(ok))[:, None] + np.arange(width)[None, :] * len(ok)).ravel()
        inner = pa.concat_arrays(picked).take(pa.array(order))
    else:
        inner = pa.array([], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets), inner)
    lists = pc.if_else(pa.array(error == ""), lists, pa.scalar(None, lists.type))
    return lists, [e or None for e in error.tolist()]


def _is_data(line: pa.Array, line_no: pa.Array, kind: str) -> np.ndarray:
    text = pc.utf8_trim(line, " \t\r")
    keep = pc.and_(pc.not_equal(text, ""), pc.not_equal(line_no, 1))
    if kind in COMMENT_KINDS:
        keep = pc.and_(keep, pc.invert(pc.starts_with(text, "#")))
    if kind in SUMMARY_KINDS:
        keep = pc.and_(keep, pc.invert(pc.match_substring_regex(text, _SUMMARY)))
    return pc.fill_null(keep, False).to_numpy(zero_copy_only=False)


def parse_rows(lines: DataFrame, files: DataFrame, columns: DataFrame) -> DataFrame:
    """Every data line as ``(source_file_id, line_no, kind, values, error)``.

    ``error`` is null for a valid row, whose ``values`` stand in column order, else the first that holds of ``quoting``,
    ``column_count`` and ``invalid_value`` (then ``values`` is null). Left out, as no data: line 1 of a file, blank and
    null lines, comment lines of spreadsheets, and total and report lines of bookkeeping exports. A line without a line
    number counts as data is not possible and is left out too. Lines of a file that ``files`` doesn't list, or of a kind
    without columns, get the error ``unknown_kind``. Repeated lines stay repeated; lines of any length are read whole;
    empty tables give no rows; further columns of the inputs are not read. The two small tables describe formats: their
    size is checked, and a list of files too large to broadcast is joined by shuffle.
    """
    spec_rows = columns.select("kind", "pos", "column_name", "value_type", "required", "width").limit(MAX_SPEC_ROWS + 1).collect()
    if len(spec_rows) > MAX_SPEC_ROWS:
        raise ValueError(f"more than {MAX_SPEC_ROWS} column descriptions")
    spec: dict[str, list[ColumnSpec]] = {}
    placed = {(r["kind"], r["pos"]): r for r in spec_rows if r["kind"] is not None and r["pos"] is not None}
    for (kind, _), r in sorted(placed.items()):
        spec.setdefault(kind, []).append(ColumnSpec(r["column_name"], r["value_type"] or "text", bool(r["required"]), r["width"]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(3)
            for kind in pc.unique(kinds).to_pylist():
                same = pc.is_null(kinds) if kind is None else pc.fill_null(pc.equal(kinds, kind), False)
                part = batch.filter(pc.and_(same, pc.is_valid(batch.column(2))))
                part = part.filter(pa.array(_is_data(part.column(2), part.column(1), kind)))
                if not part.num_rows:
                    continue
                if kind in spec:
                    values, error = parse_lines(part.column(2), kind, spec[kind])
                else:
                    values, error = pa.nulls(part.num_rows, pa.list_(pa.string())), ["unknown_kind"] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), values, pa.array(error, pa.string())], ["source_file_id", "line_no", "kind", "values", "error"])

    named = files.select(F.col("id").alias("_file"), F.col("kind").alias("_kind")).where("_file is not null").groupBy("_file").agg(F.min("_kind").alias("_kind"))
    small = named.limit(MAX_SPEC_ROWS + 1).count() <= MAX_SPEC_ROWS
    raw = lines.select("source_file_id", "line_no", "line")
    joined = raw.join(F.broadcast(named) if small else named, raw["source_file_id"] == named["_file"], "left")
    return joined.select("source_file_id", F.col("line_no").cast("long").alias("line_no"), "line", "_kind").mapInArrow(parse, OUT)
