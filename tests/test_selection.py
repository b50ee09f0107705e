import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import outliers
from veritable.operators.selection import order_statistics

RNG = np.random.default_rng(5)
SHAPES = {
    "uniform": RNG.uniform(0, 1, 4_000),
    "ties": RNG.integers(0, 5, 4_000).astype(float),
    "hot third": np.where(RNG.random(4_000) < 0.34, 7.0, RNG.normal(7, 3, 4_000)),
    "hot ends": np.concatenate([np.full(1_500, -1.0), RNG.normal(0, 0.1, 1_000), np.full(1_500, 1.0)]),
    "spike": np.concatenate([RNG.normal(10, 1, 3_999), [5e5]]),
    "heavy tail": np.exp(RNG.normal(0, 6, 4_000)),
    "constant": np.full(4_000, 3.0),
    "nan quarter": np.where(RNG.random(4_000) < 0.246, np.nan, RNG.normal(0, 1, 4_000)),
    "all nan": np.full(4_000, np.nan),
    "infinities": np.concatenate([np.full(700, -np.inf), RNG.normal(0, 1, 2_600), np.full(700, np.inf)]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ranks_match_a_sort(make, shape):
    values = SHAPES[shape]
    ds = make([(float(v),) for v in values], "v double")
    ranks = [0, 1, 999, 1_000, 2_000, 3_998, 3_999]
    [found] = order_statistics(ds.df, [(F.col("v"), len(values), ranks)], limit=60)
    assert np.array_equal(found, np.sort(values)[ranks], equal_nan=True)


def test_long_texts_with_a_common_head(make):
    words = [("head " * 60) + f"{i * 37 % 1000:04d}" for i in range(1_200)]
    ds = make([(w,) for w in words], "v string")
    [found] = order_statistics(ds.df, [(F.col("v"), len(words), [0, 600, 1_199])], limit=40)
    assert found == [sorted(words)[r] for r in (0, 600, 1_199)]


@pytest.mark.parametrize("buffer_rows", [20, 200_000])
def test_nan_has_no_part_in_quartiles_and_fences(make, buffer_rows):
    values = [*range(100), 5_000] + [math.nan] * 30
    ds = make([(float(v),) for v in values], "v double")
    row = outliers.quartiles(ds, ds.columns, buffer_rows=buffer_rows).first()
    assert (row.q1, row.q3, row["values"]) == (25.0, 75.0, 101)
    stats = outliers.outlier_stats(ds, ds.columns, buffer_rows=buffer_rows).first()
    assert (stats.outliers, stats.min_outlier, stats.max_outlier) == (1, 5_000.0, 5_000.0)


def test_text_ranks(make):
    words = [f"w{i * 37 % 1000:04d}" if i % 3 else "same" for i in range(3_000)]
    ds = make([(w,) for w in words], "v string")
    ranks = [0, 10, 1_500, 2_400, 2_999]
    [found] = order_statistics(ds.df, [(F.col("v"), len(words), ranks)], limit=40)
    assert found == [sorted(words)[r] for r in ranks]


def test_quartiles_agree_on_both_ways(make):
    rows = [(float(v), None if i % 3 == 0 else int(i), None) for i, v in enumerate(SHAPES["uniform"][:500])]
    ds = make(rows, "x double, n int, gone double")
    small = outliers.quartiles(ds, ds.columns).collect()
    large = outliers.quartiles(ds, ds.columns, buffer_rows=20).collect()
    x = [r[0] for r in rows]
    n = [r[1] for r in rows if r[1] is not None]
    for got in (small, large):
        assert got[0].q1 == pytest.approx(np.quantile(x, 0.25)) and got[0].q3 == pytest.approx(np.quantile(x, 0.75))
        assert got[1].q1 == pytest.approx(np.quantile(n, 0.25)) and got[1]["values"] == len(n)
        assert got[2].q1 is None and got[2]["values"] == 0


def test_known_quartiles(make):
    ds = make([(1,), (2,), (3,), (4,)], "v int")
    row = outliers.quartiles(ds, ds.numbers).first()
    assert (row.q1, row.q3) == (1.75, 3.25)


def test_no_more_than_five_rounds_and_no_sample(make, monkeypatch):
    """Long columns of all kinds, down to parts of one value: rounds are bounded by the digits."""
    from decimal import Decimal

    from veritable.operators import selection

    rounds = []
    once = selection._round
    monkeypatch.setattr(selection, "_round", lambda *a: rounds.append(1) or once(*a))
    longs = [int(v) for v in RNG.integers(-(2**63), 2**63 - 1, 700)] + [2**63 - 1, -(2**63), 0, 0, 1, -1]
    doubles = [float(v) for v in np.concatenate([RNG.normal(0, 1, 500) * 10.0 ** RNG.integers(-300, 300, 500), [5e-324, -5e-324, 0.0, -0.0, 1e308, -1e308, math.inf, -math.inf]])]
    doubles += [1.0 + i * 2.0**-52 for i in range(198)]
    decimals = [Decimal(int(v)).scaleb(-9) for v in RNG.integers(-(10**17), 10**17, len(longs))]
    small = [int(v) for v in RNG.integers(-5, 5, len(longs))]
    rows = list(zip(longs, doubles, decimals, small))
    assert len(rows) == len(longs) == len(doubles)
    ds = make(rows, "a long, b double, c decimal(38,9), d int")
    ranks = [0, 1, 350, 500, len(rows) - 2, len(rows) - 1]
    for name, column in zip("abcd", zip(*rows)):
        rounds.clear()
        [found] = order_statistics(ds.df, [(F.col(name), len(rows), ranks)], limit=0)
        assert found == [sorted(column)[r] for r in ranks], name
        assert len(rounds) <= (4 if name in "ad" else 6)


def test_keys_of_one_type_share_the_scan_of_a_round(make, spark):
    ds = make([(float(v), float(-v), float(v % 7)) for v in range(3_000)], "a double, b double, c double")
    group = "shared-scan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = order_statistics(ds.df, [(F.col(c), 3_000, [10, 2_000]) for c in "abc"], limit=100, nans=[0, 0, 0])
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext._jsc.clearJobGroup()
    assert found == [[10.0, 2_000.0], [-2_989.0, -999.0], [0.0, 4.0]]
    assert jobs <= 12


def test_text_parts_of_one_value_and_empty_texts(make):
    words = [""] * 300 + ["a"] * 300 + ["ab"] * 300 + ["\U0001f389" * 80] * 100 + ["\uffff"] * 50 + ["a" * 64] * 50 + ["a" * 65] * 50
    ds = make([(w,) for w in words], "v string")
    ranks = list(range(0, len(words), 37))
    [found] = order_statistics(ds.df, [(F.col("v"), len(words), ranks)], limit=0)
    assert found == [sorted(words, key=lambda w: w.encode())[r] for r in ranks]
