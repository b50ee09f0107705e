"""Dominant labels of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.operators.labels import spelled
from veritable.operators.profile import label_counts
from veritable.schema import ColumnInfo
from veritable.session import localize

CONCENTRATION_FLAG = 0.40
REPORTED_COLUMNS = 2

BUCKETS = 1_024

_SCHEMA = (
    "column string, label string, count long, total long, share double, distinct_values long, "
    "runner_up string, runner_up_count long, runner_up_share double"
)


def candidate_columns(ds: Dataset) -> list[ColumnInfo]:
    """Text columns that may have a label with at least 40 % of the rows.

    Such a label brings its share to the hash bucket it falls into, so a column whose
    fullest bucket stays below cannot have one. This costs a scan and a tiny shuffle, and
    spares counting every label of columns like names or free text. A column with one value
    only has all its filled rows in one bucket; so many of the others are NULL that one of the
    two buckets reaches 40 %.
    """
    if not ds.texts:
        return []
    slot = [
        F.struct(F.lit(c.name).alias("column"), F.pmod(F.xxhash64(c.label), F.lit(BUCKETS)).alias("bucket"))
        for c in ds.texts
    ]
    buckets = ds.df.select(F.inline(F.array(*slot))).groupBy("column", "bucket").agg(F.count("*").alias("n"))
    fullest = buckets.groupBy("column").agg((F.max("n") / F.sum("n")).alias("share"))
    names = {row.column for row in fullest.where(F.col("share") >= CONCENTRATION_FLAG).collect()}
    return [c for c in ds.texts if c.name in names]


def concentration(ds: Dataset, columns: list[ColumnInfo] | None = None) -> DataFrame:
    """Per text column: the modal label, its share of all rows, and the runner-up.

    Columns whose modal label is NULL are left out. One scan counts the labels of all
    columns; the top three per column are ranked map-side first (WindowGroupLimit), so
    no task sees all labels of a column.
    """
    columns = ds.texts if columns is None else columns
    if not columns:
        return ds.df.sparkSession.createDataFrame([], _SCHEMA)
    counts = label_counts(ds, columns)
    order = [F.desc("count"), F.col("label").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    top = counts.withColumn("place", place).where("place <= 3")
    leader = F.max_by(F.struct("label", "count"), -F.col("place"))
    rivals = F.struct(F.col("count"), -F.col("place"), F.col("label"))
    rival = F.max(F.when((F.col("place") > 1) & F.col("label").isNotNull(), rivals))
    leaders = top.groupBy("column").agg(leader.alias("first"), rival.alias("second"))
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("total"), F.count("label").alias("distinct_values")
    )
    found = (
        leaders.join(totals, "column")
        .where("first.label IS NOT NULL")
        .select(
            "column", "first.label", "first.count", "total",
            (F.col("first.count") / F.col("total")).alias("share"), "distinct_values",
            F.col("second.label").alias("runner_up"),
            F.col("second.count").alias("runner_up_count"),
            (F.col("second.count") / F.col("total")).alias("runner_up_share"),
        )
    )
    shown = localize(found)  # one row per column
    for c in columns:
        shown = spelled(ds, c, shown, "label", "runner_up", where=("column", c.name))
    return shown


def _reported(ds: Dataset) -> DataFrame:
    """The two most concentrated columns of those that can be reported; later names win ties."""
    return concentration(ds, candidate_columns(ds)).orderBy(F.desc("share"), F.desc("column")).limit(REPORTED_COLUMNS)


def concentration_flagged(ds: Dataset) -> DataFrame:
    """Reported columns whose leading label holds at least 40 % of the rows."""
    several = F.col("distinct_values") > 1
    return _reported(ds).where(several & (F.col("share") >= CONCENTRATION_FLAG))


def single_value_columns(ds: Dataset) -> DataFrame:
    """Reported columns that hold one value only."""
    constant = _reported(ds).where("distinct_values <= 1")
    return constant.select("column", F.col("label").alias("only_value"), "count", "distinct_values")


def reported(ds: Dataset) -> DataFrame:
    """Flagged and single-value columns in report order."""
    kept = (F.col("distinct_values") <= 1) | (F.col("share") >= CONCENTRATION_FLAG)
    return _reported(ds).where(kept).orderBy(F.desc("share"), F.desc("column"))
