"""Metadata tables from CSV: all columns are text, encodings differ per file."""

from __future__ import annotations

import csv
import io
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.guards import require_columns
from corpusmill.plans.materialize import broadcast_if_small, materialize

# The code points in which Windows-1252 and ISO-8859-1 differ, built from the codec.
_CP1252_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_CP1252_FROM = "".join(map(chr, _CP1252_BYTES))
_CP1252_TO = bytes(_CP1252_BYTES).decode("cp1252")


# More distinct header lines than this in one table are taken for a mistake.
MOST_HEADERS = 100


def _western(raw: Column) -> Column:
    """Windows-1252 bytes as text."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _CP1252_FROM, _CP1252_TO)


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, metadata_row, line) of every data line of files of any size.

    A file is UTF-8 if all its lines are, else Windows-1252. The verdicts are a table, one
    row per file, that is joined to the raw lines; rows are counted over all files in path
    order, whatever their encodings.
    """
    lines = materialize(
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(
            F.col("value").cast("binary").alias("raw"),
            F.is_valid_utf8("value").alias("ok"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("id"),
        )
    )
    place = F.struct("start", "id")
    text = F.when(F.col("ok"), F.col("raw").cast("string")).otherwise(_western(F.col("raw")))
    files = materialize(
        lines.groupBy("path")
        .agg(F.bool_and("ok").alias("ok"), F.min_by("raw", place).alias("raw"), F.min_by("id", place).alias("header_id"))
        .select(
            "path",
            "ok",
            "header_id",
            F.regexp_replace(text, "^\ufeff", "").alias("header"),
            # One row per file; below, one per split.
            F.row_number().over(Window.orderBy("path")).alias("file_no"),
        )
    )
    earlier = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(
        lines.groupBy("path", "start")
        .agg(F.count("*").alias("n"), F.min("id").alias("id0"))
        .select("path", "start", "id0", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    placed = lines.drop("ok").join(broadcast_if_small(splits), ["path", "start"]).join(broadcast_if_small(files), "path")
    # The headers of this file and of earlier ones don't count; data begin with row 2.
    number = F.col("shift") + F.col("id") - F.col("id0") - F.col("file_no") + 2
    return placed.where("id <> header_id").select("header", number.cast("bigint").alias("metadata_row"), text.alias("line"))


def _numbered_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, metadata_row, cells) of files whose cells may hold line breaks: a task reads a file whole."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    western = str.maketrans(_CP1252_FROM, _CP1252_TO)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("path"), batch.column("content")):
                raw = content.as_py()
                try:
                    text = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = raw.decode("latin-1").translate(western)
                rows = [r for r in csv.reader(io.StringIO(text, newline="")) if len(r) > 1 or (r and r[0].strip())]
                if rows:
                    out = io.StringIO()
                    csv.writer(out, lineterminator="").writerow(rows[0])
                    n = len(rows) - 1
                    columns = [[place.as_py()] * n, [out.getvalue()] * n, range(n), rows[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["path", "header", "at", "cells"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    records = materialize(files.mapInArrow(run, "path string, header string, at bigint, cells array<string>"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    shifts = records.groupBy("path").agg(F.count("*").alias("n"))
    shifts = materialize(shifts.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")))
    placed = records.join(broadcast_if_small(shifts), "path")
    return placed.select("header", (F.col("shift") + F.col("at") + 2).alias("metadata_row"), "cells")


def header_names(line: str) -> list[str]:
    """Column names of a header line: blank ones become ``_c<position>``, repeated ones end in their position."""
    cells = next(csv.reader([line]), [])
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, number_rows: bool = False
) -> DataFrame:
    """CSV with header as text columns; each file as UTF-8 or else Windows-1252.

    Every file has a header of its own; all must name the same columns, in any order. Empty
    cells are blank, not NULL; blank lines are left out. ``multi_line`` allows line breaks
    inside quoted cells, at the price of one task per file. ``number_rows`` adds
    ``metadata_row``, counted from 2 over all files in path order, as in a spreadsheet.
    """
    rows = (_numbered_records if multi_line else _numbered_lines)(spark, path)
    found = rows.groupBy("header").agg(F.min("metadata_row").alias("_first")).orderBy("_first").limit(MOST_HEADERS + 1).collect()
    headers = [r.header for r in found]
    if not headers:
        headers = _headers_without_rows(spark, path)
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers under {path}")
    names = {h: header_names(h) for h in headers}
    columns = names[headers[0]]
    for h in headers[1:]:
        if sorted(names[h]) != sorted(columns):
            raise ValueError(f"files under {path} have different columns: {columns} and {names[h]}")
    if not multi_line:
        width = max(len(n) for n in names.values())
        fields = ", ".join(f"c{i} string" for i in range(width))
        parsed = F.from_csv("line", fields, {"escape": '"'})
        rows = rows.withColumn("_cells", parsed).withColumn("cells", F.array(*[f"_cells.c{i}" for i in range(width)]))

    def cell(name: str) -> Column:
        value = None
        for h in headers:
            here = F.get("cells", F.lit(names[h].index(name)))
            value = F.when(F.col("header") == h, here) if value is None else value.when(F.col("header") == h, here)
        return F.coalesce(value, F.lit("")).alias(name)

    return rows.select(*(["metadata_row"] if number_rows else []), *[cell(c) for c in columns])


def _headers_without_rows(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The header of files that hold nothing else."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").cast("binary").alias("raw")).first()
    if first is None:
        raise ValueError(f"no CSV file with a header under {path}")
    raw = bytes(first.raw)
    try:
        return [raw.decode("utf-8-sig")]
    except UnicodeDecodeError:
        return [raw.decode("latin-1").translate(str.maketrans(_CP1252_FROM, _CP1252_TO))]


def read_metadata(
    spark: SparkSession, path: str | list[str], required: Sequence[str], **options
) -> DataFrame:
    """``read_csv`` that insists on the named columns."""
    return require_columns(read_csv(spark, path, **options), required)


def column_index(letters: str) -> int:
    """Zero-based position of a spreadsheet column name."""
    name = letters.strip().upper()
    if not name or any(c not in string.ascii_uppercase for c in name):
        raise ValueError(f"not a spreadsheet column: {letters!r}")
    places = enumerate(reversed(name))
    return sum((string.ascii_uppercase.index(c) + 1) * 26**place for place, c in places) - 1


def column_letters(index: int) -> str:
    """Spreadsheet column name of a zero-based position."""
    if index < 0:
        raise ValueError(f"not a column position: {index}")
    width, first = 1, 0
    while index >= first + 26**width:
        first, width = first + 26**width, width + 1
    offset = index - first
    return "".join(
        string.ascii_uppercase[offset // 26**place % 26] for place in range(width - 1, -1, -1)
    )


def label_range(columns: Sequence[str], cells: str) -> list[tuple[str, str]]:
    """(column, header) pairs of a range such as ``AP:AT``; blank headers become letters."""
    ends = [column_index(p) for p in cells.split(":")]
    if len(ends) > 2:
        raise ValueError(f"not a column range: {cells!r}")
    if ends[0] > ends[-1]:
        raise ValueError(f"range ends before it starts: {cells!r}")
    picked = []
    for i in range(ends[0], ends[-1] + 1):
        if i >= len(columns):
            raise ValueError(f"column {column_letters(i)} is beyond the last column")
        header = columns[i].strip()
        unnamed = not header or header == f"_c{i}"
        picked.append((columns[i], column_letters(i) if unnamed else header))
    return picked


def select_label_range(df: DataFrame, cells: str, keep: Sequence[str] = ("matched_ids",)) -> DataFrame:
    """Columns of a spreadsheet range, after the ``keep`` columns."""
    names = [c for c in df.columns if c != "metadata_row"]
    kept = [c for c in df.columns if c.lower() in {k.lower() for k in keep} or c == "metadata_row"]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[F.col(f"`{c}`").alias(h) for c, h in label_range(names, cells)],
    )


def infer_label_columns(df: DataFrame, after: str = "matched_ids") -> list[str]:
    """All columns behind ``after``; there must be at least one."""
    require_columns(df, [after])
    labels = df.columns[df.columns.index(after) + 1 :]
    if not labels:
        raise ValueError(f"no label column after {after!r}")
    return labels
