"""Compare two slices: totals, series, drivers, deltas and movers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.functions.times import bucket
from veritable.functions.wording import human_number, signed_percent
from veritable.operators.charts import aggregate, pick_interval
from veritable.schema import NUMBER

TOP_DRIVERS = 30
TOP_MOVERS = 6
BLANK_LABEL = "Blank"


def _metric(ds: Dataset, agg: str, metric: str | None) -> Column:
    return aggregate(ds, agg, metric).cast("double")


def _shown(value: Column) -> Column:
    return F.coalesce(F.round(value, 4), F.lit(0.0))


def compare_total(ds: Dataset, agg: str = "count", metric: str | None = None) -> DataFrame:
    total = ds.df.agg(F.count("*").alias("row_count"), _metric(ds, agg, metric).alias("total"))
    return total.select("row_count", _shown(F.col("total")).alias("total"))


def compare_series(
    ds: Dataset, date: str, agg: str = "count", metric: str | None = None,
    interval: str | None = None,
) -> DataFrame:
    chosen = pick_interval(ds, date, interval)
    if chosen is None:
        return ds.df.sparkSession.createDataFrame([], "bucket timestamp_ntz, value double")
    buckets = ds.df.groupBy(bucket(ds.column(date).ref, chosen).alias("bucket"))
    series = buckets.agg(_shown(_metric(ds, agg, metric)).alias("value"))
    return series.orderBy(F.col("bucket").asc_nulls_last())


@dataclass(frozen=True)
class Snapshot:
    """One slice in figures: total, values over time, values by label."""

    total: DataFrame
    interval: str | None
    series: DataFrame | None
    drivers: DataFrame | None


def snapshot(
    ds: Dataset, agg: str = "count", metric: str | None = None, date: str | None = None,
    dimension: str | None = None, interval: str | None = None,
) -> Snapshot:
    """All figures of a slice; series and drivers only for the columns that are given."""
    chosen = pick_interval(ds, date, interval) if date else None
    return Snapshot(
        compare_total(ds, agg, metric), chosen,
        compare_series(ds, date, agg, metric, chosen) if date else None,
        compare_drivers(ds, dimension, agg, metric) if dimension else None,
    )


def _by_label(ds: Dataset, dimension: str, agg: str, metric: str | None) -> DataFrame:
    label = ds.column(dimension).label.alias("label")
    return ds.df.groupBy(label).agg(_metric(ds, agg, metric).alias("value"))


def compare_drivers(
    ds: Dataset, dimension: str, agg: str = "count", metric: str | None = None,
    top: int = TOP_DRIVERS,
) -> DataFrame:
    """The labels with the largest absolute metric."""
    order = [F.abs("value").desc_nulls_last(), F.col("label").asc_nulls_last()]
    largest = _by_label(ds, dimension, agg, metric).orderBy(*order).limit(top)
    return largest.select(
        F.coalesce("label", F.lit(BLANK_LABEL)).alias("label"), _shown(F.col("value")).alias("value")
    )


def compare_delta(
    base: Dataset, current: Dataset, dimension: str, agg: str = "count", metric: str | None = None
) -> DataFrame:
    """Metric per label in both slices, with the change and the change in percent.

    Both slices run into one aggregate per label, so there is no join, and a frequent
    label is reduced to one row per task before the shuffle.
    """
    value = F.lit(1) if agg == "count" else base.column(metric or "", NUMBER).ref
    for ds in (base, current):
        aggregate(ds, agg, metric)  # both must have the metric
    sides = [
        ds.df.select(
            ds.column(dimension).label.alias("label"), value.cast("double").alias("value"),
            F.lit(side).alias("side"),
        )
        for side, ds in enumerate((base, current))
    ]
    combine = {"count": F.count, "sum": F.sum, "avg": F.avg}[agg]
    labels = sides[0].unionByName(sides[1]).groupBy("label").agg(*[
        combine(F.when(F.col("side") == side, F.col("value"))).cast("double").alias(name)
        for side, name in enumerate(("base_value", "current_value"))
    ])
    delta = F.round(F.col("current_value") - F.col("base_value"), 4)
    percent = F.try_divide(100 * F.col("delta"), F.abs("base_value"))
    return (
        labels.select(
            F.coalesce("label", F.lit(BLANK_LABEL)).alias("label"),
            _shown(F.col("base_value")).alias("base_value"),
            _shown(F.col("current_value")).alias("current_value"),
        )
        .withColumn("delta", delta)
        .withColumn("pct_change", F.round(percent, 2))
    )


def compare_top_movers(
    base: Dataset, current: Dataset, dimension: str, agg: str = "count",
    metric: str | None = None, top: int = TOP_MOVERS,
) -> DataFrame:
    """The labels that moved most."""
    moved = compare_delta(base, current, dimension, agg, metric)
    return moved.orderBy(F.abs("delta").desc(), "label").limit(top)


def compare_reason(
    base: Dataset, current: Dataset, dimension: str, agg: str = "count", metric: str | None = None
) -> DataFrame:
    """Totals of both slices and one sentence that names the top mover."""
    movers = compare_top_movers(base, current, dimension, agg, metric, top=1)
    totals = [compare_total(d, agg, metric).first().total for d in (base, current)]
    before, after = (F.lit(t) for t in totals)
    change = F.round(after - before, 4)
    percent = F.round(F.try_divide(100 * change, F.abs(before)), 2)
    verb = F.when(change > 0, "rose").when(change < 0, "fell").otherwise("did not change")
    moved = F.when(F.col("delta") >= 0, "+").otherwise("-")
    reason = F.concat(
        F.lit("The total "), verb,
        F.coalesce(F.concat(F.lit(" ("), signed_percent(percent), F.lit(")")), F.lit("")),
        F.lit(f"; the largest move in {dimension} is '"), F.col("label"), F.lit("' ("),
        moved, human_number(F.abs("delta")), F.lit(")."),
    )
    return movers.select(
        before.alias("base_total"), after.alias("current_total"), change.alias("delta"),
        percent.alias("pct_change"), F.col("label").alias("top_mover"), reason.alias("reason"),
    )
