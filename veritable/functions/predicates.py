"""Filter lists compiled to typed Column predicates.

Literals are given the column's own type wherever that keeps the meaning, so that
Catalyst can push the comparison into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.schema import DATE, NUMBER, TEXT, ColumnInfo

# The comparisons each column class allows.
ALLOWED_OPS = {
    NUMBER: {"eq", "neq", "gte", "lte"},
    DATE: {"gte", "lte"},
    TEXT: {"eq", "neq", "contains"},
}

# Doubles hold every integer up to here, so an integer literal compares alike.
EXACT_INTEGERS = 2**53


def filter_predicate(
    columns: Iterable[ColumnInfo], filters: str | list[dict] | None
) -> Column | None:
    """AND of all items ``{col, op, value}``; items without a column or value are skipped."""
    if not filters:
        return None
    if isinstance(filters, str):
        try:
            filters = json.loads(filters)
        except json.JSONDecodeError as exc:
            raise ValueError("filters must be a JSON list") from exc
    if not isinstance(filters, list) or not all(isinstance(item, dict) for item in filters):
        raise ValueError("filters must be a list of {col, op, value} items")

    known = {c.name: c for c in columns}
    parts = []
    for item in filters:
        name, op, value = item.get("col"), item.get("op"), item.get("value")
        if name is None or value is None or value == "":
            continue
        if name not in known:
            raise ValueError(f"unknown column {name!r}")
        info = known[name]
        if op not in ALLOWED_OPS[info.kind]:
            raise ValueError(f"operator {op!r} does not apply to {info.kind} column {name!r}")
        parts.append(_comparison(info, op, value))
    return reduce(and_, parts) if parts else None


def _comparison(info: ColumnInfo, op: str, value) -> Column:
    if info.kind == NUMBER:
        return _compare_number(info, op, value)
    if info.kind == DATE:
        return _compare_date(info, op, value)
    if op == "contains":
        # % and _ stay wildcards, a backslash is an ordinary character
        return info.label.ilike("%" + str(value).replace("\\", "\\\\") + "%")
    return _apply(info.label, op, F.lit(str(value)))


def _apply(left: Column, op: str, right: Column) -> Column:
    if op == "eq":
        return left == right
    if op == "neq":
        return left != right
    return left >= right if op == "gte" else left <= right


def _compare_number(info: ColumnInfo, op: str, value) -> Column:
    try:
        number = float(value)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"{value!r} is not a number (column {info.name!r})") from exc
    if not info.is_integer or not math.isfinite(number) or abs(number) >= EXACT_INTEGERS:
        return _apply(info.ref, op, F.lit(number))
    if number.is_integer():
        return _apply(info.ref, op, F.lit(int(number)))
    # a fraction against integers: round the bound inwards, equality never holds
    if op == "gte":
        return info.ref >= F.lit(math.ceil(number))
    if op == "lte":
        return info.ref <= F.lit(math.floor(number))
    return info.ref.isNotNull() if op == "neq" else F.lit(False)


def _compare_date(info: ColumnInfo, op: str, value) -> Column:
    try:
        moment = dt.datetime.fromisoformat(str(value).strip())
    except ValueError as exc:
        raise ValueError(f"{value!r} is not a date (column {info.name!r})") from exc
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(info.dtype, T.DateType):
        day = F.lit(moment.date())
        if op == "gte" and moment.time() != dt.time():
            return info.ref > day
        return _apply(info.ref, op, day)
    literal = F.lit(moment.isoformat(sep=" ")).cast(info.dtype)
    return _apply(info.ref, op, literal)
