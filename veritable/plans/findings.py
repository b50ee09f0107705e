"""The findings table: one scored row per statement about a dataset."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions import scores
from veritable.session import small_table

_FIELDS: dict[str, T.DataType] = {
    "dataset_id": T.StringType(),
    "position": T.IntegerType(),
    "id": T.StringType(),
    "title": T.StringType(),
    "category": T.StringType(),
    "topic": T.StringType(),
    "plain": T.StringType(),
    "technical": T.StringType(),
    "confidence": T.DoubleType(),
    "trust_score": T.IntegerType(),
    "evidence_rows": T.ArrayType(T.LongType()),
    "evidence_columns": T.ArrayType(T.StringType()),
    "supporting_metrics": T.StringType(),
    "what_to_check_next": T.StringType(),
    "question": T.StringType(),
    "is_limitation": T.BooleanType(),
    "notability": T.DoubleType(),
}
FINDING_SCHEMA = T.StructType([T.StructField(name, dtype) for name, dtype in _FIELDS.items()])


def text(*parts: Column | str) -> Column:
    """Concatenate columns and literal text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def quoted(value: Column) -> Column:
    return text("'", F.coalesce(value, F.lit("NULL")), "'")


def metrics(**fields: Column) -> Column:
    """The numbers behind a statement, as JSON; absent ones are left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def enrich(df: DataFrame, extra: str, facts: Callable[[Row], tuple]) -> DataFrame:
    """Collect the few rows of a section and attach driver-side facts to each.

    Only called on results whose size is bounded by a report limit.
    """
    rows = [tuple(row) + tuple(facts(row)) for row in df.collect()]
    fields = df.schema.fields + T.StructType.fromDDL(extra).fields
    return small_table(df.sparkSession, rows, T.StructType(fields))


def statement(
    df: DataFrame,
    *,
    id: Column | str,
    title: Column | str,
    category: str,
    topic: str,
    plain: Column | str,
    n: Column,
    effect: Column,
    missing: Column,
    consistency: Column,
    notability: Column,
    metrics: Column,
    check_next: Column | str,
    evidence_rows: Column | None = None,
    evidence_columns: Column | None = None,
    technical: Column | str | None = None,
    question: Column | str | None = None,
    position: Column | None = None,
) -> DataFrame:
    """Findings of one section: scores are computed here and nowhere else."""
    return _shape(
        df, position=position, id=id, title=title, category=category, topic=topic, plain=plain,
        technical=technical,
        confidence=scores.confidence(n, effect), trust_score=scores.trust(n, missing, consistency),
        evidence_rows=evidence_rows, evidence_columns=evidence_columns, supporting_metrics=metrics,
        what_to_check_next=check_next, question=question, is_limitation=F.lit(False),
        notability=notability,
    )


def limitation(
    df: DataFrame,
    *,
    id: Column | str,
    title: Column | str,
    category: str,
    topic: str,
    plain: Column | str,
    check_next: Column | str,
    trust_score: int = 0,
    metrics: Column | None = None,
    evidence_columns: Column | None = None,
    dataset_id: Column | None = None,
    position: Column | None = None,
) -> DataFrame:
    """A section that cannot make a statement says so; it carries no confidence."""
    return _shape(
        df, id=id, title=title, category=category, topic=topic, plain=plain,
        dataset_id=dataset_id, position=position,
        confidence=F.lit(0.0), trust_score=F.lit(trust_score), evidence_columns=evidence_columns,
        supporting_metrics=F.lit("{}") if metrics is None else metrics,
        what_to_check_next=check_next, is_limitation=F.lit(True), notability=F.lit(0.0),
    )


def _shape(df: DataFrame, **given: Column | str | None) -> DataFrame:
    lists = {"evidence_rows", "evidence_columns"}
    columns = []
    for field in FINDING_SCHEMA:
        value: Any = given.get(field.name)
        if value is None:
            value = F.array() if field.name in lists else F.lit(None)
        elif isinstance(value, str):
            value = F.lit(value)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def one_row(spark: SparkSession, **facts: Any) -> DataFrame:
    """A single row of facts to build a statement on."""
    base = small_table(spark, [(True,)], T.StructType([T.StructField("given", T.BooleanType())]))
    return base.select(*[F.lit(value).alias(name) for name, value in facts.items()])


def names(columns: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")


def as_json(value: Any) -> Column:
    return F.lit(json.dumps(value))
