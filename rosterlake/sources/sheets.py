"""Scans of the input files.

- ``read_price_csv``: hand-made CSV (nome, ruolo, squadra, quotazione), explicit
  schema, header row, UTF-8; names used as they are (no trimming).
- ``scan_sheets``: sheets exported as CSV text where row 1 is a title and row 2
  the header (the price list and the season statistics). One lazy scan for all files:
  each is one record (a sheet holds the players of one league), parsed in the task
  that reads it, so title, header and row order are at hand and nothing comes to the
  driver. Files go through Spark's own reader, whatever store they lie in.
- ``read_sheets``: the same for columns that aren't known beforehand: the header lines
  are read first, and a missing column is an error at once.

Row order inside a file (for "last wins") is kept as an ordinal
``(file index, block start, row id within the task)``: Spark reads each file
block sequentially, so the id grows with the line within a block.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.quality import missing_columns
from rosterlake.plans.broadcast import broadcast_bounded
from rosterlake.session import ship_package

PRICE_CSV_SCHEMA = "nome string, ruolo string, squadra string, quotazione double"
HEADER_CELL = "Id"  # fixed value: the header row is the row with an "Id" cell (data rows hold numbers)


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?")


def _place(path: str) -> str:
    """A path as Spark shows it in ``_metadata.file_path``, without scheme and host:
    which file system a bare path means is the session's affair, not this process's.
    A relative path is looked up as a trailing part of the full one."""
    return quote(_SCHEME.sub("", path).rstrip("/"), safe="/:+&=@!$'()*,;~-._%")


def _file_index(paths: list[str]) -> Column:
    """Index of the row's file in ``paths``: the file itself, or the folder that holds
    it (then the folder's index); ``list`` doesn't stand for ``list2``."""
    full = F.col("_metadata.file_path")
    bare = F.regexp_replace(full, _SCHEME.pattern, "")
    idx = None
    for i, p in enumerate(paths):
        place, host = _place(p), _SCHEME.match(p)
        if place.startswith("/"):
            cond = (bare == place) | bare.startswith(place + "/")
        else:
            cond = bare.endswith("/" + place) | bare.contains(f"/{place}/")
        if host is not None and host.group(1) not in (None, "//"):      # a named host or bucket must match too
            cond = cond & full.startswith(host.group(0) + "/")
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    return idx.otherwise(F.lit(len(paths)))


def _ordinal(paths: list[str]) -> Column:
    return F.struct(_file_index(paths).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_price_csv(spark: SparkSession, paths) -> DataFrame:
    """The hand-made price CSV, with a ``_ordinal`` for last-wins dedupe."""
    paths = _as_list(paths)
    df = (spark.read.schema(PRICE_CSV_SCHEMA).option("header", True).option("encoding", "UTF-8")
          .csv(paths))
    return df.select(*df.columns, _ordinal(paths).alias("_ordinal"))


def read_sheets(spark: SparkSession, paths, required) -> DataFrame:
    """Exported sheets -> rows of text cells named by their header,
    plus ``_title``, ``_path`` and ``_ordinal``. Raises ValueError naming the
    missing required columns of a file (Q19)."""
    paths = _as_list(paths)
    # 1. The header line of each file (one per file, so bounded by the file
    #    list) decides the width and the names; parsed on the driver.
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
    has_id = F.array_contains(F.transform(F.split("value", ","), lambda x: F.trim(x)), HEADER_CELL)
    headers = lines.where(has_id).select("_path", "value").distinct().collect()
    if not headers:
        raise ValueError("no header row (a row with an 'Id' cell) found")
    layouts: dict[tuple, list[str]] = {}
    for row in headers:
        names = tuple(n.strip() for n in next(csv.reader([row["value"]])))
        miss = missing_columns([n for n in names if n], required)
        if miss:
            raise ValueError(f"missing columns in {row['_path']}: {sorted(miss)}")
        layouts.setdefault(names, []).append(row["_path"])
    width = max(len(n) for n in layouts)
    cells = [f"_c{i}" for i in range(width)]

    # 2. One scan of every file with an explicit all-text schema of that width.
    raw = (spark.read.schema(", ".join(f"{c} string" for c in cells))
           .option("header", False).option("encoding", "UTF-8").csv(paths))
    raw = raw.select(*cells, F.col("_metadata.file_path").alias("_path"), _ordinal(paths).alias("_ordinal"))
    is_header = F.coalesce(F.array_contains(F.array(*[F.trim(F.col(c)) for c in cells]), HEADER_CELL),
                           F.lit(False))
    others_empty = F.lit(True)
    for c in cells[1:]:
        others_empty = others_empty & F.col(c).isNull()
    is_title = F.coalesce(~is_header & others_empty & F.col(cells[0]).isNotNull()
                          & F.col(cells[0]).try_cast("double").isNull(), F.lit(False))

    with_header = [f for files in layouts.values() for f in files]   # files without one give no rows
    titles = (raw.where(is_title & F.col("_path").isin(with_header)).groupBy("_path")
              .agg(F.min_by(F.col(cells[0]), F.col("_ordinal")).alias("_title")))
    data = raw.where(~is_header & ~is_title)
    parts = []
    for names, files in layouts.items():
        sel = [F.col(c).alias(n) for c, n in zip(cells, names) if n]
        part = data.where(F.col("_path").isin(files)).select(*sel, "_path", "_ordinal")
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    # titles: one row per file (bounded by the file list)
    return out.join(broadcast_bounded(titles, len(headers), "one title per file"), "_path", "left")


def parse_sheet(content: bytes, path: str, columns: list[str], required) -> tuple[str | None, list[list[str | None]], list[int]]:
    """Title, data rows (the cells of ``columns``; None where empty or absent) and their line
    numbers of one exported sheet. The title is the first row before the header with one
    cell only, which is no number; a sheet without a header row has no rows."""
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")))
    at = next((i for i, row in enumerate(rows) if any(cell.strip() == HEADER_CELL for cell in row)), None)
    if at is None:
        return None, [], []
    names = [n.strip() for n in rows[at]]
    if miss := missing_columns([n for n in names if n], required):
        raise ValueError(f"missing columns in {path}: {sorted(miss)}")
    title = next((r[0] for r in rows[:at] if r and r[0] and not any(r[1:]) and not _is_number(r[0])), None)
    place = {n: k for k, n in reversed(list(enumerate(names)))}         # of repeated names the first
    picked, lines = [], []
    for line, row in enumerate(rows[at + 1:], at + 1):
        if any(row):
            picked.append([(row[k] or None) if (k := place.get(c, -1)) >= 0 and k < len(row) else None for c in columns])
            lines.append(line)
    return title, picked, lines


def _is_number(text: str) -> bool:
    try:
        float(text)
        return True
    except ValueError:
        return False


def scan_sheets(spark: SparkSession, paths, required, optional=()) -> DataFrame:
    """S2/S3/S4 in one lazy scan: the text cells of the ``required`` and ``optional``
    columns, plus ``_title``, ``_path`` and ``_ordinal`` (as ``read_sheets``). A file that lacks
    a required column fails the query that reads it, naming the columns (Q19)."""
    paths = _as_list(paths)
    ship_package(spark)
    columns = [*required, *(c for c in optional if c not in required)]
    files = (spark.read.format("binaryFile").load(paths)
             .select(F.col("_metadata.file_path").alias("_path"), _file_index(paths).alias("_file"), "content"))
    needed = list(required)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, content in zip(*(c.to_pylist() for c in batch.columns)):
                title, rows, lines = parse_sheet(content, path, columns, needed)
                n = len(rows)
                cells = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns))]
                place = pa.StructArray.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(lines, pa.int64())], names=["file", "block", "row"])
                yield pa.RecordBatch.from_arrays(
                    [*cells, pa.array([path] * n, pa.string()), place, pa.array([title] * n, pa.string())], names=[*columns, "_path", "_ordinal", "_title"])

    kinds = ", ".join(f"`{c}` string" for c in columns)
    return files.mapInArrow(emit, f"{kinds}, _path string, _ordinal struct<file:int,block:bigint,row:bigint>, _title string")
