"""Row volume over time: daily counts, trend, weekday and month rhythm."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.functions.scores import unit
from veritable.functions.times import WEEKDAYS, bucket, month_name, weekday_name
from veritable.schema import DATE
from veritable.operators.labels import short_label, spelled
from veritable.operators.profile import SMALL_SAMPLE

TREND_MIN_BUCKETS = 3
TREND_MIN_R2 = 0.30
EVEN_DAY = 1.0 / 7.0
WEEKDAY_SKEW = 1.3


def daily_counts(ds: Dataset, date: str) -> DataFrame:
    """Rows per calendar day; rows without a date are left out.

    The result has one row per day, which every operator below reads instead of the
    table.
    """
    moment = ds.column(date, DATE).ref
    days = ds.df.where(moment.isNotNull()).groupBy(bucket(moment, "day").alias("day"))
    return days.agg(F.count("*").alias("count"))


def trend_fit(days: DataFrame) -> DataFrame:
    """Least-squares line through the daily counts, against the ordinal of the day.

    Days without rows are not counted. The window has no partition, but only one row per
    calendar day.
    """
    ordinal = F.row_number().over(Window.orderBy("day")) - 1
    points = days.withColumn("x", ordinal.cast("double")).withColumn("y", F.col("count").cast("double"))
    constant = F.var_pop("y") == 0
    fit = F.greatest(F.lit(0.0), F.regr_r2("y", "x"))
    return points.agg(
        F.count("*").alias("buckets"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.when(constant, 0.0).otherwise(fit).alias("r_squared"),
        F.min_by("count", "day").alias("first_count"),
        F.max_by("count", "day").alias("last_count"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("dated_rows"),
    )


def trend_verdict(days: DataFrame) -> DataFrame:
    """Direction of the line, and how steady it is."""
    clear = (F.col("r_squared") >= TREND_MIN_R2) & (F.round("slope", 2) != 0)
    # The words that metrics use for direction and steadiness.
    return trend_fit(days).where(F.col("buckets") >= TREND_MIN_BUCKETS).select(
        "*",
        F.when(~clear, "flat").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
        .alias("direction"),
        F.when(F.col("r_squared") >= 0.8, "very consistent")
        .when(F.col("r_squared") >= 0.5, "fairly consistent").otherwise("rough").alias("steadiness"),
    )


def weekday_counts(days: DataFrame) -> DataFrame:
    return days.groupBy(weekday_name(F.col("day")).alias("weekday")).agg(F.sum("count").alias("count"))


def busiest_weekday(days: DataFrame) -> DataFrame:
    """The weekday with most rows, if there are 30 dated rows and it is clearly ahead."""
    counts = weekday_counts(days)
    whole = F.sum("count").over(Window.partitionBy())  # seven rows
    ranked = counts.withColumn("dated_rows", whole).orderBy(F.desc("count"), "weekday").limit(1)
    share = F.col("count") / F.col("dated_rows")
    skewed = (F.col("dated_rows") >= SMALL_SAMPLE) & (F.col("share") >= WEEKDAY_SKEW * EVEN_DAY)
    return (
        ranked.withColumn("share", share)
        .where(skewed)
        .withColumn("effect", unit(F.col("share") * 7.0 - 1.0))
    )


def peak_month(days: DataFrame) -> DataFrame:
    """The month name with most rows, if the days span two calendar months; years merge."""
    months = days.groupBy(F.date_trunc("month", F.col("day")).alias("start")).agg(
        F.sum("count").alias("count")
    )
    named = months.groupBy(month_name(F.col("start")).alias("month")).agg(
        F.sum("count").alias("count"), F.count("*").alias("starts")
    )
    spanned = F.sum("starts").over(Window.partitionBy())  # at most twelve rows
    several = named.withColumn("calendar_months", spanned).where("calendar_months >= 2")
    return several.orderBy(F.desc("count"), "month").limit(1).drop("starts")


def label_weekdays(ds: Dataset, date: str, category: str, *more: Column) -> DataFrame:
    """Dated rows per label, in total and per weekday, and any further counters.

    One pass: every label is one row with its counters, so a frequent label does not
    gather its rows anywhere. Long labels are shortened (see ``labels``).
    """
    moment = ds.column(date, DATE).ref
    counters = [
        F.count_if(F.weekday(moment) == i).alias(day.lower()) for i, day in enumerate(WEEKDAYS)
    ]
    labels = ds.df.where(moment.isNotNull()).groupBy(short_label(ds.column(category)).alias("label"))
    return labels.agg(F.count("*").alias("label_rows"), *counters, *more)


def leading_weekday(ds: Dataset, labels: DataFrame, category: str) -> DataFrame:
    """The leading label and its own busiest weekday, if that is clearly ahead."""
    leader = labels.orderBy(F.desc("label_rows"), F.col("label").asc_nulls_last()).limit(1)
    days = F.array(*[
        F.struct(F.lit(day).alias("weekday"), F.col(day.lower()).alias("count")) for day in WEEKDAYS
    ])
    best = leader.where("label IS NOT NULL").select("label", "label_rows", F.inline(days))
    top = best.orderBy(F.desc("count"), "weekday").limit(1)
    share = F.col("count") / F.col("label_rows")
    skewed = (F.col("label_rows") >= SMALL_SAMPLE) & (share >= WEEKDAY_SKEW * EVEN_DAY)
    shown = [F.lit(category).alias("column"), "label", "label_rows", "weekday", "count"]
    return spelled(ds, ds.column(category), top.where(skewed).select(*shown), "label")


def category_peak_weekday(ds: Dataset, date: str, category: str) -> DataFrame:
    """``leading_weekday`` of a text column."""
    return leading_weekday(ds, label_weekdays(ds, date, category), category)


def edge_days(days: DataFrame, count: int) -> tuple[datetime, datetime] | None:
    """The last of the first days, and the first of the last days, that hold ``count`` rows."""
    ordered = days.orderBy("day").collect()
    if not ordered:
        return None
    ends = []
    for walk in (ordered, ordered[::-1]):
        seen = 0
        for row in walk:
            seen += row["count"]
            if seen >= count:
                break
        ends.append(row.day)
    return ends[0], ends[1]
