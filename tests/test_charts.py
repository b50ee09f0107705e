import datetime as dt

import pytest

from veritable.functions.times import choose_interval
from veritable.operators import charts, compare


@pytest.fixture(scope="module")
def table(make):
    day = dt.datetime(2024, 1, 1, 10)
    rows = [
        (day, "a", 1.0), (day, "a", 2.0), (day, None, None), (day + dt.timedelta(days=2), "b", 4.0),
        (None, "a", 5.0),
    ]
    return make(rows, "ts timestamp_ntz, k string, v double")


def test_category_counts_keep_null(table):
    assert [tuple(r) for r in charts.category_counts(table, "k").collect()] == [("a", 3), ("b", 1), (None, 1)]


def test_interval_choice():
    assert choose_interval(10, None) == "hour"
    assert choose_interval(3_600 * 2_000) == "hour"
    assert choose_interval(3_600 * 2_001) == "day"
    assert choose_interval(3_600 * 2_001, "hour") == "day"
    assert choose_interval(10, "month") == "month"
    assert choose_interval(31_536_000 * 9_999) == "year"


def test_time_series_ends_with_undated_rows(table):
    series = charts.time_series(table, "ts", interval="day").collect()
    assert [(r.bucket and r.bucket.day, r.value) for r in series] == [(1, 3.0), (3, 1.0), (None, 1.0)]
    means = charts.time_series(table, "ts", "avg", "v", "day").collect()
    assert [r.value for r in means] == [1.5, 4.0, 5.0]


def test_time_series_arguments(table):
    for args in (("ts", "median"), ("ts", "sum"), ("ts", "sum", "k"), ("k",)):
        with pytest.raises(ValueError):
            charts.time_series(table, *args)
    with pytest.raises(ValueError):
        charts.time_series_split(table, "ts", "ts")


def test_series_without_dates_is_empty(table):
    none = table.where(table.column("ts").ref.isNull())
    assert charts.time_series(none, "ts").count() == 0
    assert charts.time_series_grid(none, "ts", "k").count() == 0


def test_split_grid_fills_gaps(table):
    grid = [(r.bucket and r.bucket.day, r.key, r.value) for r in charts.time_series_grid(table, "ts", "k", interval="day").collect()]
    assert grid == [
        (1, "(blank)", 1.0), (1, "a", 2.0), (1, "b", None), (3, "(blank)", None), (3, "a", None), (3, "b", 1.0),
        (None, "(blank)", None), (None, "a", 1.0), (None, "b", None),
    ]


def test_split_takes_eight_keys(make):
    rows = [(dt.date(2024, 1, 1), f"k{i}") for i in range(12) for _ in range(i + 1)]
    keys = {r.key for r in charts.time_series_split(make(rows, "d date, k string"), "d", "k").collect()}
    assert keys == {f"k{i}" for i in range(4, 12)}


def test_histogram(make):
    bins = charts.numeric_histogram(make([(float(v),) for v in (0, 1, 15, 29, 30)], "v double"), "v").collect()
    counts = {r.bin: r["count"] for r in bins if r["count"]}
    assert len(bins) == 30 and counts == {0: 1, 1: 1, 15: 1, 29: 2}
    assert (bins[0].label, bins[29].bin_end) == ("0–1", 30.0)


def test_histogram_of_one_value_and_of_none(make):
    one = charts.numeric_histogram(make([(2.5,), (2.5,), (None,)], "v double"), "v").collect()
    assert [tuple(r) for r in one] == [(0, "2.5", 2.5, 2.5, 2)]
    assert charts.numeric_histogram(make([(None,)], "v double"), "v").count() == 0


def test_compare_snapshot(table):
    assert tuple(compare.compare_total(table, "sum", "v").first()) == (5, 12.0)
    drivers = compare.compare_drivers(table, "k", "sum", "v").collect()
    assert [tuple(r) for r in drivers] == [("a", 8.0), ("b", 4.0), ("Blank", 0.0)]
    series = compare.compare_series(table, "ts", "sum", "v", "day").collect()
    assert [r.value for r in series] == [3.0, 4.0, 5.0]


def test_snapshot_has_what_is_asked_for(table):
    whole = compare.snapshot(table, "sum", "v", date="ts", dimension="k", interval="day")
    assert (whole.interval, whole.series.count(), whole.drivers.count()) == ("day", 3, 3)
    total_only = compare.snapshot(table)
    assert total_only.total.first().total == 5.0
    assert total_only.interval is total_only.series is total_only.drivers is None
    for wrong in ({"agg": "sum"}, {"agg": "median"}, {"date": "k"}, {"dimension": "zzz"}):
        with pytest.raises(ValueError):
            compare.snapshot(table, **wrong)


def test_compare_delta_of_two_slices(table):
    base = table.slice([{"col": "v", "op": "lte", "value": 2}])
    found = {r.label: tuple(r)[1:] for r in compare.compare_delta(base, table, "k").collect()}
    assert found == {"a": (2.0, 3.0, 1.0, 50.0), "b": (0.0, 1.0, 1.0, None), "Blank": (0.0, 1.0, 1.0, None)}
    movers = compare.compare_top_movers(base, table, "k", "sum", "v").collect()
    assert [r.label for r in movers] == ["a", "b", "Blank"]


def test_compare_reason_names_the_mover(table):
    base = table.slice([{"col": "v", "op": "lte", "value": 2}])
    row = compare.compare_reason(base, table, "k", "sum", "v").first()
    assert (row.base_total, row.current_total, row.delta, row.pct_change, row.top_mover) == (3.0, 12.0, 9.0, 300.0, "a")
    assert "'a'" in row.reason and "about 4× more" in row.reason


def test_compare_plan_has_no_join(table):
    plan = compare.compare_delta(table, table, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
