"""Confidence and trust, the two scores every finding carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SAMPLE = 50.0


def unit(value: Column) -> Column:
    """Clamp to 0..1; NULL stays NULL."""
    return F.when(value < 0, 0.0).when(value > 1, 1.0).otherwise(value)


def sample_weight(n: Column) -> Column:
    """Grows linearly to 1 at 50 rows."""
    return F.least(F.lit(1.0), n / F.lit(FULL_SAMPLE))


def confidence(n: Column, effect: Column) -> Column:
    """0..1: enough rows times a real effect."""
    return F.round(unit(sample_weight(n) * unit(effect)), 3)


def trust(n: Column, missing: Column, consistency: Column) -> Column:
    """0..100: rows, completeness and consistency multiplied."""
    complete = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), missing))
    return F.rint(F.lit(100) * sample_weight(n) * complete * unit(consistency)).cast("int")
