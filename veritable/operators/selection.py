"""Exact order statistics over columns of any size, by radix selection.

A sorted copy of a large column, or one aggregation buffer with all its values, would not fit
in a task. Instead every round gives each value a digit that never falls as values grow, counts
the rows of each digit, and goes on inside the digit that holds the wanted rank. What is
shuffled is a count for each digit, at most 65,536 (some 70,000 in the first round of doubles).

- Whole numbers and moments: the upper 16 bits first; from then on the place between the least
  and the greatest value of the digit before, in 65,536 equal parts. Four rounds at most.
- Doubles and decimals: sign and sixteenths of an octave first, which far outliers cannot
  stretch; then equal parts between the least and the greatest value, five rounds at most.
- Texts: the next two characters. What all texts of a digit have in common is skipped, up to 64
  characters a round, and no more of a text than that is shuffled.

A round ends where a digit holds a single value, and digits of few rows are counted value by value
at the end. Nothing is sampled, so rounds and result are the same in every run. NaN is the
highest value, as in a sort; it is counted apart.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a digit that are counted value by value instead of in another round.
BRACKET_ROWS = 200_000
DIGITS = 1 << 16
OCTAVE_PARTS = 16
# Beyond the exponent of any double, so that the sign decides first.
_SIGN = 40_000
TEXT_CHARS, TEXT_WINDOW = 2, 64


@dataclass(frozen=True)
class _Digit:
    """The rows of one key that a round left: their least and greatest value, or what their texts begin with."""

    key: Column
    kind: T.DataType
    rows: int
    below: int = 0
    low: Any = None
    high: Any = None
    head: str = ""

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, T.StringType)

    def holds(self) -> Column:
        if self.is_text:
            return F.startswith(self.key, F.lit(self.head)) if self.head else self.key.isNotNull()
        if self.low is None:
            return self.key.isNotNull()
        return (self.key >= F.lit(self.low).cast(self.kind)) & (self.key <= F.lit(self.high).cast(self.kind))

    def digit(self) -> Column:
        """The digit of a value of this part; it never falls as values grow."""
        if self.is_text:
            return F.substring(self.key, len(self.head) + 1, TEXT_CHARS)
        if isinstance(self.kind, T.LongType):
            if self.low is None:
                return F.shiftright(self.key, 48)
            step = (self.high - self.low) // DIGITS + 1
            return F.floor((self.key - F.lit(self.low)) / F.lit(step))
        value = self.key.cast("double")
        if self.low is None:
            size = F.floor(F.log2(F.abs(value)) * OCTAVE_PARTS) + _SIGN
            size = F.when(F.abs(value) == float("inf"), F.lit(2 * _SIGN)).otherwise(size)
            return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")
        part = (self.key - F.lit(self.low).cast(self.kind)).cast("double") / F.lit(float(self.high - self.low))
        return F.floor(F.least(part, F.lit(1.0)) * (DIGITS - 1))

    def shown(self) -> Column:
        return F.substring(self.key, len(self.head) + 1, TEXT_WINDOW) if self.is_text else self.key

    def inside(self, below: int, rows: int, low: Any, high: Any) -> tuple[_Digit, Any]:
        """The part that one digit makes, and its value if it has a single one."""
        part = replace(self, below=self.below + below, rows=rows)
        if not self.is_text:
            return replace(part, low=low, high=high), low if low == high else None
        common = os.path.commonprefix([low, high])
        ended = low == high and len(low) < TEXT_WINDOW
        return replace(part, head=self.head + common), self.head + low if ended else None


@dataclass
class _Ranks:
    """Wanted ranks that lie in the same part."""

    part: _Digit
    wanted: list[tuple[int, int]] = field(default_factory=list)

    def goals(self, place: int) -> list[Column]:
        return [
            F.struct(F.lit(place).alias("place"), F.lit(i).alias("i"), F.lit(rank - self.part.below).cast("long").alias("goal"))
            for i, rank in self.wanted
        ]


def _at_goals(counts: DataFrame, by: str, groups: list[_Ranks]) -> DataFrame:
    """Of counts per place, the rows in whose run a goal lies, with the rows before them as `under`."""
    upto = F.sum("n").over(Window.partitionBy("place").orderBy(by))
    goals = [goal for place, group in enumerate(groups) for goal in group.goals(place)]
    hit = F.filter(F.array(*goals), lambda g: (g["place"] == F.col("place")) & (F.col("upto") > g["goal"]) & (F.col("upto") - F.col("n") <= g["goal"]))
    return counts.withColumn("upto", upto).withColumn("g", F.explode(hit)).withColumn("under", F.col("upto") - F.col("n"))


def _placed(df: DataFrame, groups: list[_Ranks], **columns) -> DataFrame:
    """A row for each row of the table and each group that holds it."""
    hits = [
        F.when(g.part.holds(), F.struct(F.lit(place).alias("place"), *[make(g.part).alias(name) for name, make in columns.items()]))
        for place, g in enumerate(groups)
    ]
    near = reduce(or_, [g.part.holds() for g in groups])
    return df.where(near).select(F.inline(F.array_compact(F.array(*hits))))


def _round(df: DataFrame, groups: list[_Ranks], values: list) -> list[_Ranks]:
    """Count the digits of all groups in one scan; the parts that hold the ranks still open."""
    digits = _placed(df, groups, digit=_Digit.digit, value=_Digit.shown).groupBy("place", "digit")
    counts = digits.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    found: dict[tuple, _Ranks] = {}
    for row in _at_goals(counts, "digit", groups).collect():
        old, i = groups[row.place], row.g.i
        part, value = old.part.inside(row.under, row.n, row.low, row.high)
        if value is not None:
            values[i] = value
        else:
            rank = next(rank for at, rank in old.wanted if at == i)
            found.setdefault((row.place, row.digit), _Ranks(part)).wanted.append((i, rank))
    return list(found.values())


def _by_value(df: DataFrame, groups: list[_Ranks], values: list) -> None:
    """Count parts of few rows value by value, all in one scan."""
    counts = _placed(df, groups, value=lambda part: part.key).groupBy("place", "value").agg(F.count("*").alias("n"))
    for row in _at_goals(counts, "value", groups).collect():
        values[row.g.i] = row.value


def _without_nan(
    df: DataFrame, wanted: list[tuple[Column, int, list[int]]], nans: list[int] | None
) -> tuple[list[Column], list[int], list[T.DataType]]:
    """The keys with NULL in place of NaN, how many values that leaves, and what they are selected as."""
    keys = [key for key, _, _ in wanted]
    kinds = [f.dataType for f in df.select(*[key.alias(f"k{i}") for i, key in enumerate(keys)]).schema]
    floats = [i for i, kind in enumerate(kinds) if isinstance(kind, (T.DoubleType, T.FloatType))]
    if floats and nans is None:
        found = df.agg(*[F.count_if(F.isnan(keys[i])).alias(f"n{i}") for i in floats]).first()
        nans = [found[floats.index(i)] if i in floats else 0 for i in range(len(keys))]
    nans = nans or [0] * len(keys)
    numbers = [rows - n for (_, rows, _), n in zip(wanted, nans)]
    own = []
    for key, n, kind in zip(keys, nans, kinds):
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType))
        kept = F.when(~F.isnan(key), key) if n else key
        own.append((kept.cast("long"), T.LongType()) if whole else (kept.cast("double"), T.DoubleType()) if isinstance(kind, T.FloatType) else (kept, kind))
    return [key for key, _ in own], numbers, [kind for _, kind in own]


def order_statistics(
    df: DataFrame, wanted: list[tuple[Column, int, list[int]]], limit: int = BRACKET_ROWS,
    nans: list[int] | None = None,
) -> list[list[Any]]:
    """The values at 0-based ranks; ``wanted`` holds (key, non-null rows, ranks).

    ``limit`` is the number of rows up to which a part is counted value by value; ``nans``
    the NaN among each key's rows, which are counted where they are not given. All keys share
    the scan of a round; keys of different types take a scan for each type.
    """
    keys, numbers, kinds = _without_nan(df, wanted, nans)
    ranks = [(slot, rank) for slot, (_, _, of) in enumerate(wanted) for rank in of]
    values: list[Any] = [math.nan if rank >= numbers[slot] else None for slot, rank in ranks]
    for kind in dict.fromkeys(kinds):
        groups = []
        for slot, key in enumerate(keys):
            open_ = [(i, rank) for i, (at, rank) in enumerate(ranks) if at == slot and values[i] is None]
            if kinds[slot] == kind and open_:
                groups.append(_Ranks(_Digit(key, kind, numbers[slot]), open_))
        small: list[_Ranks] = []
        while groups:
            small += [g for g in groups if g.part.rows <= limit]
            groups = [g for g in groups if g.part.rows > limit]
            groups = _round(df, groups, values) if groups else []
        if small:
            _by_value(df, small, values)
    results = iter(values)
    return [[next(results) for _ in of] for _, _, of in wanted]
