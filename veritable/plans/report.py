"""The evidence report over one dataset or slice."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.dataset import Dataset
from veritable.operators import profile
from veritable.operators.profile import SMALL_SAMPLE
from veritable.plans import sections
from veritable.plans.findings import FINDING_SCHEMA, limitation, names, one_row
from veritable.plans.lens import apply_lens, audience_mode
from veritable.plans.ranking import follow_ups, key_takeaways, one_question, top_findings
from veritable.plans.sections import Facts
from veritable.schema import ROW_ID
from veritable.session import localize, small_table

log = logging.getLogger(__name__)

Section = Callable[[Facts], DataFrame]

PARALLEL_SECTIONS = 8

# In report order: title, category, builder.
SECTIONS: list[tuple[str, str, Section]] = [
    ("Executive summary", "executive_summary", sections.executive),
    ("Missing data", "missing_data", sections.missing_data),
    ("Concentration", "hidden_patterns", sections.dominant_labels),
    ("Trend", "hidden_patterns", sections.trend),
    ("Time pattern", "hidden_patterns", sections.time_pattern),
    ("Correlations", "correlations", sections.correlations),
    ("Anomalies", "anomalies", sections.anomalies),
    ("What changed most", "what_changed_most", sections.what_changed),
]


@dataclass(frozen=True)
class Report:
    """All parts of a report as DataFrames; ``as_dict`` gives them as plain values."""

    dataset_id: str
    mode: str
    quality: DataFrame
    missing: DataFrame
    key_numbers: DataFrame
    date_range: DataFrame
    duplicate_examples: DataFrame
    findings: DataFrame
    takeaways: DataFrame
    questions: DataFrame
    column_types: dict[str, str]

    @staticmethod
    def _sample_message(rows: int | None) -> str:
        if rows is None:
            return "The rows could not be counted."
        if rows < SMALL_SAMPLE:
            return f"There are {rows} rows, fewer than {SMALL_SAMPLE}: take every finding as a hint."
        return f"{rows} rows are enough for these checks."

    def as_dict(self) -> dict[str, Any]:
        quality = self.quality.first()
        rows = quality.rows if quality else None
        span = self.date_range.first()
        insights = []
        for row in self.findings.orderBy("position").collect():
            card = row.asDict()
            card["supporting_metrics"] = json.loads(card["supporting_metrics"])
            for internal in ("dataset_id", "position", "mode"):
                card.pop(internal)
            insights.append(card)
        blanks = {
            row.column: {k: row[k] for k in ("missing", "missing_fraction", "missing_pct", "type")}
            for row in self.missing.collect()
        }
        numbers = {
            row.column: {k: row[k] for k in ("sum", "avg", "min", "max")}
            for row in self.key_numbers.collect()
        }
        examples = [row[0] for row in self.duplicate_examples.collect()]
        return {
            "dataset_id": self.dataset_id,
            "mode": self.mode,
            "summary": {
                "rows": rows, "columns": len(self.column_types), "column_types": self.column_types,
                "date_range": span.asDict() if span else None, "key_numbers": numbers,
            },
            "data_quality": {
                "missing_by_column": blanks, "duplicate_rows": quality.duplicate_rows if quality else None,
                "duplicate_example_rows": examples,
                "small_sample_warning": {
                    "triggered": bool(quality and quality.small_sample), "row_count": rows,
                    "threshold": SMALL_SAMPLE, "message": self._sample_message(rows),
                },
            },
            "insights": insights,
            "key_takeaways": [
                {"rank": r.rank, "source_insight": r.source_insight, "text": r.text}
                for r in self.takeaways.collect()
            ],
            "follow_up_questions": [r.text for r in self.questions.collect()],
        }


def guarded(facts: Facts, title: str, category: str, build: Section) -> list:
    """Run one section; a failure becomes a limitation instead of ending the report."""
    try:
        return build(facts).collect()
    except Exception as exc:  # any failure of one section must leave the others standing
        log.warning("section %s failed: %r", title, exc)
        return unavailable(facts, title, category, exc)


def unavailable(facts: Facts, title: str, category: str, exc: Exception) -> list:
    """The limitation that stands where a part of the report failed."""
    return limitation(
        one_row(facts.spark, failed=True), id=f"{title.lower().replace(' ', '_')}_unavailable",
        title=f"{title}: left out", category=category, topic="limitation",
        plain=f"Computing this part ended with {type(exc).__name__}. Nothing is said about it here; "
              "all other parts are unaffected.",
        evidence_columns=names(facts.ds.names), check_next="Run the report on a narrower slice, or read the log for the cause.",
    ).collect()


def prepared(facts: Facts) -> DataFrame:
    facts.prepare()
    return small_table(facts.spark, [], FINDING_SCHEMA)


def section_findings(facts: Facts) -> DataFrame:
    """Executive summary and all sections, unranked, in report order."""
    ds = facts.ds
    if facts.total == 0:
        rows = limitation(
            one_row(facts.spark, total=0), id="no_data", title="No rows left",
            category="executive_summary", topic="limitation",
            plain="No row passes the filters, so there is nothing to report on.",
            check_next="Remove or loosen a filter.",
        ).collect()
    else:
        rows = guarded(facts, "Shared counts", "executive_summary", prepared)
        # sections only wait for Spark; side by side their small jobs fill the cluster
        with ThreadPoolExecutor(max_workers=PARALLEL_SECTIONS) as pool:
            results = pool.map(lambda section: guarded(facts, *section), SECTIONS)
        rows += [row for result in results for row in result]
        rows = with_evidence(facts, rows)
    numbered = [(ds.name, 100 * (i + 1), *row[2:]) for i, row in enumerate(rows)]
    return small_table(facts.spark, numbered, FINDING_SCHEMA)


def with_evidence(facts: Facts, found: list) -> list:
    """Findings with the row ids that their marks stand for; without any if they cannot be read."""
    place = FINDING_SCHEMA.names.index("evidence_rows")
    try:
        resolve = facts.resolved()
    except Exception as exc:  # the findings stand without their rows
        log.warning("evidence rows failed: %r", exc)
        found = found + unavailable(facts, "Evidence rows", "executive_summary", exc)
        resolve = lambda ids: [] if ids and ids[0] < 0 else ids
    return [(*row[:place], resolve(row[place]), *row[place + 1 :]) for row in found]


def with_headlines(findings: DataFrame) -> DataFrame:
    """Put the headline cards between the executive summary and the sections."""
    body = findings.where("category <> 'executive_summary'")
    tops = top_findings(body).withColumn("position", F.lit(100) + F.col("position"))
    return findings.unionByName(tops)


@dataclass
class _Parts:
    """Parts of a report, each computed on its own; one that fails is left empty and said so."""

    facts: Facts
    failed: list

    def take(self, title: str, build: Callable[[], DataFrame], empty: str | T.StructType) -> DataFrame:
        try:
            return localize(build())
        except Exception as exc:  # any failure of one part must leave the others standing
            log.warning("part %s failed: %r", title, exc)
            self.failed += unavailable(self.facts, title, "executive_summary", exc)
            return self.facts.spark.createDataFrame([], empty)


_QUALITY = (
    "rows long, columns int, numeric_columns int, date_columns int, text_columns int, duplicate_rows long, "
    "mean_missing double, small_sample boolean"
)
_MISSING = "position int, column string, type string, missing long, missing_fraction double, missing_pct double"
_NUMBERS = "position int, column string, sum double, avg double, min double, max double"
_RANGE = "column string, min string, max string, span_days long"
_TAKEAWAYS = "dataset_id string, rank int, source_insight string, text string"
_QUESTIONS = "position int, text string"


def build_report(ds: Dataset, filters: str | list[dict] | None = None, mode: str | None = None) -> Report:
    """The report over a dataset, optionally filtered and worded for an audience.

    Whatever cannot be computed is missing from the report and named in a limitation; the rest
    of the report stands.
    """
    ds = ds.slice(filters)
    facts = Facts(ds)
    parts = _Parts(facts, [])
    take = parts.take
    found = take("Findings", lambda: section_findings(facts), FINDING_SCHEMA)
    body = found.where("category <> 'executive_summary'")
    quality = take("Data quality", lambda: profile.data_quality(ds, facts.base, facts.distinct), _QUALITY)
    known = quality.first()
    duplicates = known.duplicate_rows if known else 0
    examples = take(
        # without duplicates no search for examples is needed
        "Duplicate examples", lambda: profile.duplicate_examples(ds if duplicates else ds.where(F.lit(False)), known.rows if known else 0),
        f"{ROW_ID} long",
    )
    if known and known.rows == 0:
        questions = one_question(facts.spark, "Which of the filters, taken alone, still keeps rows?")
        headed = found
    else:
        questions = take("Questions", lambda: follow_ups(body, duplicates), _QUESTIONS)
        headed = take("Headlines", lambda: with_headlines(found), FINDING_SCHEMA) if not found.isEmpty() else found
        headed = found if headed.isEmpty() else headed
    missing = take("Missing values", lambda: profile.missing_by_column(ds, facts.base), _MISSING)
    numbers = take("Key numbers", lambda: profile.key_numbers(ds, facts.base), _NUMBERS)
    span = take("Date range", lambda: profile.date_range(ds, facts.base), _RANGE)
    takeaways = take("Takeaways", lambda: key_takeaways(body), _TAKEAWAYS)
    if parts.failed:
        noted = [(ds.name, 90_000 + i, *row[2:]) for i, row in enumerate(parts.failed)]
        headed = headed.unionByName(small_table(facts.spark, noted, FINDING_SCHEMA))
    return Report(
        dataset_id=ds.name, mode=audience_mode(mode), quality=quality, missing=missing, key_numbers=numbers,
        date_range=span, duplicate_examples=examples, findings=apply_lens(headed, mode).orderBy("position"),
        takeaways=takeaways, questions=questions, column_types={c.name: c.kind for c in ds.columns},
    )
