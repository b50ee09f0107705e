"""A uniform sample table of any size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.schema import ROW_ID

CATEGORIES = ["copper", "flint", "amber", "slate"]
REGIONS = ["coast", "hills", "plain"]
DEFAULT_ROWS = 10_000_000


def _pick(labels: list[str], seed: int) -> Column:
    index = (F.rand(seed) * len(labels)).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, labels)), index)


def uniform_table(
    spark: SparkSession, rows: int = DEFAULT_ROWS, seed: int = 42, end: dt.datetime | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Rows without any pattern: five years of moments, values 0..100, two categories."""
    end = (end or dt.datetime.now()).replace(microsecond=0)
    span = 5 * 365 * 86_400
    start = F.lit((end - dt.timedelta(seconds=span)).isoformat(sep=" ")).cast("timestamp_ntz")
    second = F.floor(F.rand(seed) * span).cast("long")
    return spark.range(0, rows, 1, partitions).select(
        (F.col("id") + 1).alias("id"),
        (start + F.make_dt_interval(secs=second.cast("decimal(18,6)"))).alias("timestamp"),
        F.round(F.rand(seed + 1) * 100, 2).alias("value"),
        _pick(CATEGORIES, seed + 2).alias("category"),
        _pick(REGIONS, seed + 3).alias("region"),
        F.col("id").alias(ROW_ID),
    )
