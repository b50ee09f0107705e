"""Audience lens: the same findings, worded for five kinds of reader.

Only text changes. Each "why it matters" joins what is at stake in a topic with what the
reader is likely to do about it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.session import small_table

# The audiences and the two that also get the technical clause.
MODES = ("student", "analyst", "founder", "manager", "researcher")
DEFAULT_MODE = "analyst"
TECHNICAL_MODES = ("analyst", "researcher")

STAKES = {
    "executive_summary": "size and column types set the limits of all that follows",
    "missing_data": "blank cells shift every average built on the column",
    "concentration": "one large group speaks for the total and hides the rest",
    "trend": "a steady drift makes early and late rows hard to compare",
    "time_pattern": "a weekly rhythm can pass for growth or decline",
    "correlation": "two columns that move together may share a cause, or none",
    "no_correlation": "neither column can stand in for the other",
    "anomalies": "a few extreme rows can carry a whole average",
    "what_changed": "one group may account for most of the movement between the halves",
    "limitation": "nothing is claimed here, so nothing should be concluded",
}

READERS = {
    "student": "Worth learning to spot: {}.",
    "analyst": "Settle this before modelling: {}.",
    "founder": "Before you bet on a number, remember: {}.",
    "manager": "When you report this, keep in mind: {}.",
    "researcher": "State it with the sample size: {}.",
}

SUMMARY_LEAD_IN = {"student": "In short: "}


def lens_table(spark) -> DataFrame:
    """One row per topic and audience."""
    rows = [
        (topic, mode, frame.format(stake), mode in TECHNICAL_MODES)
        for topic, stake in STAKES.items()
        for mode, frame in READERS.items()
    ]
    text = [T.StructField(name, T.StringType()) for name in ("topic", "mode", "why_it_matters")]
    return small_table(spark, rows, T.StructType([*text, T.StructField("technical_reader", T.BooleanType())]))


def audience_mode(mode: str | None) -> str:
    return mode if mode in MODES else DEFAULT_MODE


def apply_lens(findings: DataFrame, mode: str | None = DEFAULT_MODE) -> DataFrame:
    """Word the findings for one audience; numbers and scores stay as they are."""
    mode = audience_mode(mode)
    table = lens_table(findings.sparkSession).where(F.col("mode") == mode)
    clause = F.when(
        F.col("technical_reader") & F.col("technical").isNotNull(),
        F.concat(F.lit(" ("), F.col("technical"), F.lit(")")),
    ).otherwise("")
    lead_in = F.when(
        F.col("topic") == "executive_summary", F.lit(SUMMARY_LEAD_IN.get(mode, ""))
    ).otherwise("")
    # the template table is fixed: ten topics, one audience
    worded = findings.join(F.broadcast(table), "topic", "left")
    return worded.select(
        "dataset_id", "position", "id", "title", "category", "mode",
        F.concat(lead_in, F.col("plain"), F.coalesce(clause, F.lit(""))).alias("explanation"),
        "why_it_matters", "confidence", "trust_score", "evidence_rows", "evidence_columns",
        "supporting_metrics", "what_to_check_next", "is_limitation",
    )
