"""IQR fences: quartiles, values outside, the columns they matter most in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.operators.profile import Measures
from veritable.operators.selection import BRACKET_ROWS, order_statistics
from veritable.schema import ColumnInfo

FENCE = 1.5
REPORTED_COLUMNS = 3
MIN_ROWS = 20
SEVERE_SHARE = 0.05

_QUARTILE_SCHEMA = "position int, column string, q1 double, q3 double, values long"


def quartiles(
    ds: Dataset, columns: list[ColumnInfo], buffer_rows: int = BRACKET_ROWS, filled: list[int] | None = None
) -> DataFrame:
    """Exact first and third quartile (linear interpolation) of each column, NaN left out.

    ``filled`` holds the number of values (neither NULL nor NaN) of the columns where it is known.

    Columns go through radix selection, whatever their size; ``buffer_rows`` is the number of
    values from which on it narrows them before it counts them one by one.
    """
    spark = ds.df.sparkSession
    if not columns:
        return spark.createDataFrame([], _QUARTILE_SCHEMA)
    counts = filled or ds.df.agg(*[F.count(c.measured) for c in columns]).first()
    shares = (0.25, 0.75)
    filled = [(i, c) for i, c in enumerate(columns) if counts[i]]
    wanted = []
    for i, c in filled:
        places = [int(share * (counts[i] - 1)) for share in shares]
        ranks = [r for place in places for r in (place, min(place + 1, counts[i] - 1))]
        wanted.append((c.measured, counts[i], ranks))
    found = {}
    for (i, _), values in zip(filled, order_statistics(ds.df, wanted, buffer_rows, nans=[0] * len(wanted))):
        for j, share in enumerate(shares):
            below, above = values[2 * j : 2 * j + 2]
            part = share * (counts[i] - 1) % 1
            found[i, share] = below + (above - below) * part
    records = [
        (i, c.name, found.get((i, 0.25)), found.get((i, 0.75)), counts[i])
        for i, c in enumerate(columns)
    ]
    return spark.createDataFrame(records, _QUARTILE_SCHEMA)


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)


def outlier_stats(
    ds: Dataset, columns: list[ColumnInfo], buffer_rows: int = BRACKET_ROWS, filled: list[int] | None = None
) -> DataFrame:
    """Values outside the fences of each column with a positive IQR, in one scan."""
    fences = [
        (row, row.q3 - row.q1)
        for row in quartiles(ds, columns, buffer_rows, filled).collect()
        if row.q1 is not None and row.q3 - row.q1 > 0
    ]
    aggregates, records = {}, []
    for row, iqr in fences:
        i = row.position
        value = columns[i].measured
        low, high = row.q1 - FENCE * iqr, row.q3 + FENCE * iqr
        beyond = outside(value, F.lit(low), F.lit(high))
        aggregates |= {
            f"n{i}": F.count_if(beyond),
            f"lo{i}": F.min(F.when(beyond, value)),
            f"hi{i}": F.max(F.when(beyond, value)),
        }
        records.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(row.column).alias("column"),
                F.lit(row.q1).alias("q1"), F.lit(row.q3).alias("q3"), F.lit(iqr).alias("iqr"),
                F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence"),
                F.col(f"n{i}").alias("outliers"), F.lit(row["values"]).alias("values"),
                (F.col(f"n{i}") / F.lit(row["values"])).alias("fraction"),
                F.col(f"lo{i}").alias("min_outlier"), F.col(f"hi{i}").alias("max_outlier"),
            )
        )
    if not records:
        schema = (
            "position int, column string, q1 double, q3 double, iqr double, lower_fence double, "
            "upper_fence double, outliers long, values long, fraction double, "
            "min_outlier double, max_outlier double"
        )
        return ds.df.sparkSession.createDataFrame([], schema)
    return Measures(aggregates, records).table(ds)


def outlier_top_columns(
    ds: Dataset, columns: list[ColumnInfo], buffer_rows: int = BRACKET_ROWS, filled: list[int] | None = None
) -> DataFrame:
    """The three columns with the largest share of outliers."""
    stats = outlier_stats(ds, columns, buffer_rows, filled).where("outliers > 0")
    return stats.orderBy(F.desc("fraction"), "position").limit(REPORTED_COLUMNS)
