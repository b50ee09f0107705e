"""Date and time expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket lengths in seconds, finest first.
INTERVAL_SECONDS = {
    "hour": 3_600,
    "day": 86_400,
    "week": 604_800,
    "month": 2_592_000,
    "year": 31_536_000,
}
MAX_BUCKETS = 2_000
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def bucket(moment: Column, interval: str) -> Column:
    """Start of the hour, day, ISO week, month or year."""
    return F.date_trunc(interval, moment).cast("timestamp_ntz")


def weekday_name(moment: Column) -> Column:
    return F.date_format(moment, "EEEE")


def month_name(moment: Column) -> Column:
    return F.date_format(moment, "MMMM")


def epoch_micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def epoch_seconds(moment: Column) -> Column:
    return epoch_micros(moment) / F.lit(1e6)


def iso_text(moment: Column, separator: str = "T", is_date: bool = False) -> Column:
    """ISO 8601 text; microseconds are written only where there are some."""
    if is_date:
        return F.date_format(moment, "yyyy-MM-dd")
    whole = F.date_format(moment, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    fraction = F.date_format(moment, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def choose_interval(span_seconds: float, requested: str | None = None) -> str:
    """The requested interval if it stays within the bucket limit, else the finest that does."""
    span = max(float(span_seconds), 1.0)
    fitting = [i for i, s in INTERVAL_SECONDS.items() if span / s <= MAX_BUCKETS]
    if requested in fitting:
        return requested
    return fitting[0] if fitting else "year"


def interval_expr(span_seconds: Column, requested: str | None = None) -> Column:
    """``choose_interval`` as an expression."""
    span = F.greatest(span_seconds.cast("double"), F.lit(1.0))
    order = list(INTERVAL_SECONDS)
    if requested in INTERVAL_SECONDS:
        order.insert(0, requested)
    chosen = F.lit("year")
    for interval in reversed(order):
        fits = span / F.lit(float(INTERVAL_SECONDS[interval])) <= MAX_BUCKETS
        chosen = F.when(fits, interval).otherwise(chosen)
    return chosen
