"""Delimited text (CSV, TSV) read with inferred types."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.schema import ref
from veritable.sources.records import split_records

# The separators that are tried.
SEPARATORS = [",", "\t", ";", "|"]

_READ_OPTIONS = {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"'}
_RAGGED = "__line"
_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_OFFSET = r"\d{1,2}:\d{2}.*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)\s*$"
_CLOCK_TIME = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"


def scan_delimited(
    spark: SparkSession, path: str, sep: str | None = None, row_cap: int | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """A CSV or TSV file or folder with a header row; types come from all rows.

    Short rows are padded with NULLs, longer ones get further columns; repeated and empty
    header names get a suffix. A row cap loads the first rows only. ``multiline`` tells whether quoted fields hold
    line breaks; by default the text is searched for them. Such text is cut into records by all tasks and
    stored once; what follows reads the records.
    """
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        raise ValueError("no columns were found: the file is empty")
    sep = sep or guess_separator(head.value)
    if multiline is None:
        multiline = _has_long_records(lines)
    options, source = _READ_OPTIONS | {"sep": sep}, path
    if multiline:
        records = split_records(spark, path, head.value)
        if records:
            source, options["lineSep"] = records
        else:
            options["multiLine"] = True
    table = _typed(lambda **extra: spark.read.csv(source, **options, **extra), head.value, sep)
    return table.limit(row_cap) if row_cap else table


def scan_text(spark: SparkSession, text: str, sep: str | None = None) -> DataFrame:
    """Pasted CSV or TSV text."""
    if not text.strip():
        raise ValueError("there is no text to read")
    head = text.splitlines()[0]
    sep = sep or guess_separator(head)
    # a quoted field may hold line breaks, so records are cut by the csv module
    records = list(csv.reader(text.splitlines(keepends=True), delimiter=sep))
    lines = [_join(r, sep) for r in records if r]
    rdd = spark.sparkContext.parallelize(lines)
    options = _READ_OPTIONS | {"sep": sep}
    return _typed(lambda **extra: spark.read.csv(rdd, **options, **extra), head, sep)


def _join(record: list[str], sep: str) -> str:
    special = {sep, '"', "\n", "\r"}
    return sep.join(
        '"' + cell.replace('"', '""') + '"' if special & set(cell) else cell for cell in record
    )


def guess_separator(header: str) -> str:
    """The separator that cuts the header line into most cells."""
    return max(SEPARATORS, key=lambda sep: len(next(csv.reader([header], delimiter=sep), [])))


def _has_long_records(lines: DataFrame) -> bool:
    """Whether a quoted field spans lines. Only then a file cannot be split over tasks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def header_names(header: str, sep: str, width: int) -> list[str]:
    """Names of the header line, filled up and made unique without regard to case."""
    cells = next(csv.reader([header], delimiter=sep), [])
    names, taken = [], set()
    for i in range(width):
        base = cells[i].strip().lstrip("﻿") if i < len(cells) else ""
        name = base = base or f"column{i}"
        suffix = 0
        while name.lower() in taken:
            suffix += 1
            name = f"{base}_{suffix}"
        taken.add(name.lower())
        names.append(name)
    return names


def _typed(read, header: str, sep: str) -> DataFrame:
    """Infer types over all rows. Clock times stay text; moments have no time zone, and those
    written with an offset are given in UTC. Cells beyond the header become text columns.
    """
    inferred = read(inferSchema=True)
    width = len(inferred.columns)
    plain = [f"_c{i}" for i in range(width)]
    moments = [i for i, f in enumerate(inferred.schema) if isinstance(f.dataType, T.TimestampType)]
    types = [f.dataType for f in inferred.schema]
    raw = read(
        schema=_schema([*plain, _RAGGED], [T.StringType()] * (width + 1)), columnNameOfCorruptRecord=_RAGGED,
    )
    cells = F.size(F.split(F.col(_RAGGED), re.escape(sep)))
    # the reader only knows lines of odd length where every column is read
    looks = {"cells": F.max(F.when(F.col(_RAGGED).isNotNull(), cells))} | {f"filled{c}": F.count(c) for c in plain}
    for i in moments:
        # a bare clock time would be read as a moment of today
        looks[f"clock{i}"] = F.bool_or(F.col(plain[i]).rlike(_CLOCK_TIME))
        looks[f"zoned{i}"] = F.bool_or(F.col(plain[i]).rlike(_OFFSET))
    seen = raw.agg(*[look.alias(name) for name, look in looks.items()]).first()
    for i in moments:
        clock, zoned = seen[f"clock{i}"], seen[f"zoned{i}"]
        types[i] = T.StringType() if clock else T.TimestampType() if zoned else T.TimestampNTZType()
    extra = _cells_beyond(raw, width, seen.cells, sep)
    names = header_names(header, sep, width + extra)
    table = read(schema=_schema([f"_c{i}" for i in range(width + extra)], types + [T.StringType()] * extra))
    in_utc = [
        F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(f"_c{i}", F.current_timezone()), _MICROS)).alias(f"_c{i}")
        if i < width and isinstance(types[i], T.TimestampType) else F.col(f"_c{i}")
        for i in range(width + extra)
    ]
    return table.select(*in_utc).toDF(*names)


def _cells_beyond(raw: DataFrame, width: int, cells: int | None, sep: str) -> int:
    """How many cells the longest row has beyond the header.

    Lines of another length than the header are looked at again: quoted cells and what else
    they hold are taken out, and the separators that are left are counted. A quoted cell begins after a
    separator or at the start of the line, and two quotes in it stand for one.
    """
    if not cells or cells <= width:
        return 0
    mark = re.escape(sep)
    plain = F.regexp_replace(F.col(_RAGGED), f'(?s)(^|{mark})"(?:[^"]|"")*+"', "$1x")
    filled = F.size(F.split(plain, mark))
    every = [F.count(c) for c in raw.columns]
    return max(raw.where(F.col(_RAGGED).isNotNull()).agg(F.max(filled), *every).first()[0] - width, 0)


def _schema(names: list[str], types: list[T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in zip(names, types)])


def validate(df: DataFrame) -> DataFrame:
    """Refuse tables without columns, header or rows."""
    if not df.columns:
        raise ValueError("no columns were found in the file")
    if all(re.fullmatch(r"(column|_c)\d+", name) for name in df.columns):
        raise ValueError("there is no header row; the first row must name the columns")
    if df.select(*[ref(c) for c in df.columns[:1]]).isEmpty():
        raise ValueError("there are no data rows below the header")
    return df
