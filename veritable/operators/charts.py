"""Chart data: category counts, time series (plain and split), histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.functions.times import bucket, choose_interval, epoch_micros, interval_expr
from veritable.functions.wording import chart_number
from veritable.operators.labels import short_label, spelled
from veritable.schema import DATE, NUMBER, ColumnInfo

TOP_CATEGORIES = 50
TOP_SERIES = 8
BINS = 30
BLANK_KEY = "(blank)"
CHART_AGGREGATES = ("count", "avg", "sum")


def category_counts(ds: Dataset, column: str, top: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent labels, the NULL label included."""
    info = ds.column(column)
    counts = ds.df.groupBy(short_label(info).alias("label")).agg(F.count("*").alias("count"))
    shown = spelled(ds, info, counts.orderBy(F.desc("count"), F.col("label").asc_nulls_last()).limit(top), "label")
    return shown.orderBy(F.desc("count"), F.col("label").asc_nulls_last())


def aggregate(ds: Dataset, agg: str, value_column: str | None) -> Column:
    """``count``, or ``avg``/``sum`` of a numeric column."""
    if agg not in CHART_AGGREGATES:
        raise ValueError("agg must be count, avg or sum")
    if agg == "count":
        return F.count("*")
    if not value_column:
        raise ValueError(f"agg {agg!r} needs a numeric column")
    info = ds.column(value_column, NUMBER)
    if agg == "avg":
        return F.avg(info.ref.cast("double"))
    return F.sum(info.ref.cast("decimal(38,0)") if info.is_integer else info.ref)


def time_extent(ds: Dataset, column: str) -> DataFrame:
    """Seconds between the first and last moment, NULL for a column without values."""
    moment = ds.column(column, DATE).ref
    micros = epoch_micros(F.max(moment)) - epoch_micros(F.min(moment))
    return ds.df.agg((micros / F.lit(1e6)).alias("span_seconds"))


def auto_interval(ds: Dataset, column: str, requested: str | None = None) -> DataFrame:
    """The bucket length a time series over ``column`` will take."""
    return time_extent(ds, column).select(
        F.lit(column).alias("column"),
        F.greatest("span_seconds", F.lit(1.0)).alias("span_seconds"),
        interval_expr(F.col("span_seconds"), requested).alias("interval"),
    )


def pick_interval(ds: Dataset, column: str, requested: str | None = None) -> str | None:
    """``auto_interval`` as a value; None where the column has no values."""
    span = time_extent(ds, column).first().span_seconds
    return None if span is None else choose_interval(span, requested)


_SERIES_SCHEMA = "bucket timestamp_ntz, value double"
_SPLIT_SCHEMA = "bucket timestamp_ntz, key string, value double"


def time_series(
    ds: Dataset,
    column: str,
    agg: str = "count",
    value_column: str | None = None,
    interval: str | None = None,
) -> DataFrame:
    """One value per time bucket, in time order; rows without a date form the last bucket."""
    value = aggregate(ds, agg, value_column)
    chosen = pick_interval(ds, column, interval)
    if chosen is None:
        return ds.df.sparkSession.createDataFrame([], _SERIES_SCHEMA)
    buckets = ds.df.groupBy(bucket(ds.column(column).ref, chosen).alias("bucket"))
    series = buckets.agg(F.round(value.cast("double"), 4).alias("value"))
    return series.orderBy(F.col("bucket").asc_nulls_last())


def series_keys(ds: Dataset, split_by: str, top: int = TOP_SERIES) -> list[str]:
    """The most frequent keys of the split column; NULL counts as ``(blank)``."""
    info = ds.column(split_by)
    key = F.coalesce(short_label(info), F.lit(BLANK_KEY)).alias("key")
    counts = ds.df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return [row.key for row in spelled(ds, info, counts, "key").collect()]


def _has_key(info: ColumnInfo, keys: list[str]) -> Column:
    """Plain IN on the column, so that the scan can use it."""
    listed = info.label.isin(keys)
    return listed | info.ref.isNull() if BLANK_KEY in keys else listed


def _split(
    ds: Dataset, column: str, split_by: str, agg: str, value_column: str | None, interval: str | None, top: int
) -> tuple[DataFrame, list[str]]:
    """Unsorted values per bucket and key, and the keys."""
    if split_by == column:
        raise ValueError("split_by must differ from the date column")
    info = ds.column(split_by)
    value = aggregate(ds, agg, value_column)
    chosen = pick_interval(ds, column, interval)
    keys = series_keys(ds, split_by, top) if chosen else []
    if not keys:
        return ds.df.sparkSession.createDataFrame([], _SPLIT_SCHEMA), []
    groups = ds.where(_has_key(info, keys)).df.groupBy(
        bucket(ds.column(column).ref, chosen).alias("bucket"),
        F.coalesce(info.label, F.lit(BLANK_KEY)).alias("key"),
    )
    return groups.agg(F.round(value.cast("double"), 4).alias("value")), keys


def time_series_split(
    ds: Dataset,
    column: str,
    split_by: str,
    agg: str = "count",
    value_column: str | None = None,
    interval: str | None = None,
    top: int = TOP_SERIES,
) -> DataFrame:
    """One value per time bucket and key, for the top keys of ``split_by``."""
    series, _ = _split(ds, column, split_by, agg, value_column, interval, top)
    return series.orderBy(F.col("bucket").asc_nulls_last(), "key")


def time_series_grid(
    ds: Dataset,
    column: str,
    split_by: str,
    agg: str = "count",
    value_column: str | None = None,
    interval: str | None = None,
    top: int = TOP_SERIES,
) -> DataFrame:
    """``time_series_split`` with every key in every bucket, NULL where there are no rows.

    Each bucket holds at most ``top`` keys, so a map per bucket fills the gaps without a
    join against all (bucket, key) combinations.
    """
    series, keys = _split(ds, column, split_by, agg, value_column, interval, top)
    if not keys:
        return series
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("by_key")
    listed = F.explode(F.array(*[F.lit(k) for k in keys])).alias("key")
    filled = series.groupBy("bucket").agg(entries).select("bucket", "by_key", listed)
    grid = filled.select("bucket", "key", F.try_element_at("by_key", "key").alias("value"))
    return grid.orderBy(F.col("bucket").asc_nulls_last(), "key")


def nan_count(ds: Dataset, column: str) -> DataFrame:
    """How many values of a numeric column are NaN, which charts and fences leave out."""
    value = ds.column(column, NUMBER).ref.cast("double")
    return ds.df.agg(F.count_if(F.isnan(value)).alias("nan_rows")).select(F.lit(column).alias("column"), "nan_rows")


_HISTOGRAM_SCHEMA = "bin int, label string, bin_start double, bin_end double, count long"


def numeric_histogram(ds: Dataset, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins between min and max, empty bins included; NaN is left out (see ``nan_count``)."""
    info = ds.column(column, NUMBER)
    spark = ds.df.sparkSession
    value = info.measured
    bounds = ds.df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    low, high, n = bounds.first()
    if n == 0:
        return spark.createDataFrame([], _HISTOGRAM_SCHEMA)
    if high <= low:
        single = bounds.select(F.lit(0).alias("bin"), F.col("lo"), F.col("n").alias("count"))
        return single.select(
            "bin", chart_number(F.col("lo")).alias("label"),
            F.col("lo").alias("bin_start"), F.col("lo").alias("bin_end"), "count",
        )
    width = (high - low) / bins
    place = F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
    counts = (
        ds.df.where(value.isNotNull())
        .groupBy(F.least(F.lit(bins - 1), place).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    start = F.lit(low) + F.col("bin") * F.lit(width)
    end = start + F.lit(width)
    # both sides hold at most one row per bin
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            F.concat(chart_number(start), F.lit("–"), chart_number(end)).alias("label"),
            F.round(start, 6).alias("bin_start"),
            F.round(end, 6).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )

