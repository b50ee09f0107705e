"""Earlier half against later half of the time span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.functions.times import epoch_seconds, iso_text
from veritable.operators.labels import short_label
from veritable.schema import DATE

MIN_HALF_ROWS = 5
REPORTED_MOVERS = 6


def time_midpoint(ds: Dataset, date: str) -> DataFrame:
    """The moment halfway between first and last; no row where there is no span."""
    moment = ds.column(date, DATE).ref
    return midpoint_of(ds.df.agg(F.min(moment).alias("first"), F.max(moment).alias("last")))


def midpoint_of(ends: DataFrame) -> DataFrame:
    """``time_midpoint`` from a row with the first and last moment."""
    seconds = ends.select(
        epoch_seconds(F.col("first")).alias("first_epoch"), epoch_seconds(F.col("last")).alias("last_epoch")
    )
    middle = (F.col("first_epoch") + F.col("last_epoch")) / 2.0
    # the printed moment is rounded to whole microseconds
    moment = F.timestamp_micros(F.rint(F.col("mid_epoch") * 1e6).cast("long"))
    return (
        seconds.where("last_epoch > first_epoch")
        .withColumn("mid_epoch", middle)
        .withColumn("midpoint", iso_text(moment))
    )


def _halves(ds: Dataset, date: str, middle: float) -> tuple[Column, Column]:
    seconds = epoch_seconds(ds.column(date, DATE).ref)
    return seconds < F.lit(middle), seconds >= F.lit(middle)


def half_counters(ds: Dataset, date: str, middle: float) -> list[Column]:
    before, after = _halves(ds, date, middle)
    return [F.count_if(before).alias("first_half"), F.count_if(after).alias("second_half")]


def half_change(ds: Dataset, date: str, dimension: str, middle: float) -> DataFrame:
    """Rows per label before and after the midpoint, in one conditional aggregate.

    Long labels are shortened (see ``labels``), also in the results below that are made of this.
    """
    labels = ds.df.where(ds.column(date).ref.isNotNull()).groupBy(
        short_label(ds.column(dimension)).alias("label")
    )
    return with_delta(labels.agg(*half_counters(ds, date, middle)))


def with_delta(halves: DataFrame) -> DataFrame:
    moved = F.col("second_half") - F.col("first_half")
    return halves.select("label", "first_half", "second_half", moved.alias("delta"))


def _by_move() -> list[Column]:
    return [F.abs("delta").desc(), F.col("label").asc_nulls_last()]


def top_movers(halves: DataFrame, top: int = REPORTED_MOVERS) -> DataFrame:
    """Labels by size of the change."""
    return halves.orderBy(*_by_move()).limit(top)


def half_totals(halves: DataFrame) -> DataFrame:
    return halves.agg(
        F.count("*").alias("labels"),
        F.coalesce(F.sum("first_half"), F.lit(0)).alias("first_rows"),
        F.coalesce(F.sum("second_half"), F.lit(0)).alias("second_rows"),
    )


def top_mover(halves: DataFrame) -> DataFrame:
    """The biggest mover, its change in percent and the size of the effect."""
    base = F.greatest(F.lit(1), F.col("first_half"))
    return top_movers(halves, 1).select(
        "*",
        (F.lit(100.0) * F.col("delta") / base).alias("pct"),
        F.least(F.lit(1.0), F.abs("delta") / base).alias("effect"),
    )


def leader_gap(halves: DataFrame) -> DataFrame:
    """First and second label by rows, and how far ahead the first is.

    Only given when the biggest mover is the leader, so that "now ahead" is true.
    """
    total = F.col("first_half") + F.col("second_half")
    # the higher label wins a tie, a NULL label reads as 'None'
    named = F.coalesce("label", F.lit("None"))
    ranked = halves.select("label", total.alias("total"), named.alias("named"))
    two = ranked.orderBy(F.desc("total"), F.desc("named")).limit(2)
    pair = two.agg(F.sort_array(F.collect_list(F.struct("total", "named", "label")), False).alias("top"))
    mover = top_movers(halves, 1).select(F.col("label").alias("mover"))
    leader, second = F.get("top", 0), F.get("top", 1)
    named = pair.select(
        leader["label"].alias("leader"), leader["total"].alias("leader_total"),
        second["label"].alias("second_label"), second["total"].alias("second_total"),
    ).where("leader <> '' AND second_label <> '' AND second_total > 0")
    gap = (F.col("leader_total") - F.col("second_total")) / F.col("second_total") * 100
    held = named.join(mover, F.col("leader") == F.col("mover"), "left_semi")
    return held.withColumn("lead_pct", F.round(gap, 2))


def half_volume(ds: Dataset, date: str, middle: float) -> DataFrame:
    """All rows before and after the midpoint."""
    before, after = _halves(ds, date, middle)
    counts = ds.df.agg(F.count_if(before).alias("first_rows"), F.count_if(after).alias("second_rows"))
    base = F.greatest(F.lit(1), F.col("first_rows"))
    return counts.withColumn("delta", F.col("second_rows") - F.col("first_rows")).select(
        "*",
        (F.lit(100.0) * F.col("delta") / base).alias("pct"),
        F.least(F.lit(1.0), F.abs("delta") / base).alias("effect"),
    )
