import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritable.operators import change, charts, concentration, outliers, relations, timeline
from veritable.operators.labels import spelled


def days_of(make, counts, start=dt.date(2026, 1, 5)):
    """Daily counts as a table of rows, from a Monday on."""
    rows = [(start + dt.timedelta(days=i),) for i, n in enumerate(counts) for _ in range(n)]
    return timeline.daily_counts(make(rows, "date date"), "date")


# --- concentration ---------------------------------------------------------------------


def test_concentration_counts_null_rows_in_the_total(make):
    ds = make([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 2, "s string")
    row = concentration.concentration(ds).first()
    assert (row.label, row["count"], row.total, row.share, row.distinct_values) == ("a", 6, 10, 0.6, 2)
    assert (row.runner_up, row.runner_up_count) == ("b", 2)


def test_blank_leader_is_skipped_and_blank_runner_up_too(make):
    assert concentration.concentration(make([(None,)] * 3 + [("a",)], "s string")).count() == 0
    ds = make([("a",)] * 5 + [(None,)] * 4 + [("b",)], "s string")
    assert concentration.concentration(ds).first().runner_up == "b"


def test_ties_go_to_the_lower_label(make):
    row = concentration.concentration(make([("b",), ("a",), ("c",)], "s string")).first()
    assert (row.label, row.runner_up) == ("a", "b")


def test_only_two_columns_are_reported(make):
    ds = make([("x", "x", "x", i % 2 == 0) for i in range(10)], "a string, b string, c string, d boolean")
    assert {r.column for r in concentration.single_value_columns(ds).collect()} == {"b", "c"}
    assert concentration.concentration_flagged(ds).count() == 0


def test_numbers_only_have_no_concentration(make):
    assert concentration.concentration_flagged(make([(1,)], "n int")).count() == 0


def test_ruling_out_columns_changes_nothing(make):
    rows = [
        (f"u{i}", "a" if i % 5 < 2 else f"b{i}", "x" if i % 2 else None, None if i % 3 else "y", f"g{i % 3}")
        for i in range(600)
    ]
    ds = make(rows, "name string, leads string, single string, blank string, even string")
    kept = (F.col("distinct_values") <= 1) | (F.col("share") >= concentration.CONCENTRATION_FLAG)
    every = concentration.concentration(ds).orderBy(F.desc("share"), F.desc("column")).limit(2).where(kept)
    whole = every.orderBy(F.desc("share"), F.desc("column")).collect()
    assert [c.name for c in concentration.candidate_columns(ds)] == ["leads", "single", "blank"]
    assert concentration.reported(ds).collect() == whole and len(whole) == 2
    assert concentration.reported(make([("a",), ("b",), ("c",)], "s string")).count() == 0


# --- time line -------------------------------------------------------------------------


def test_trend_of_a_line(make):
    row = timeline.trend_verdict(days_of(make, [2 + i // 2 for i in range(60)])).first()
    assert row.direction == "increasing" and row.steadiness == "very consistent"
    assert row.buckets == 60 and row.slope == pytest.approx(0.5, abs=0.01)
    falling = timeline.trend_verdict(days_of(make, [40 - i for i in range(30)])).first()
    assert falling.direction == "decreasing" and falling.r_squared == pytest.approx(1.0)


def test_constant_volume_has_no_fit(make):
    row = timeline.trend_verdict(days_of(make, [3] * 10)).first()
    assert (row.r_squared, row.direction, row.slope) == (0.0, "flat", 0.0)


def test_gaps_between_days_collapse(make):
    spread = days_of(make, [1, 0, 0, 0, 2, 0, 0, 0, 3])
    row = timeline.trend_fit(spread).first()
    assert (row.buckets, row.slope) == (3, 1.0)


def test_two_days_are_no_trend(make):
    assert timeline.trend_verdict(days_of(make, [1, 2])).count() == 0


def test_flat_week_has_no_busiest_day(make):
    assert timeline.busiest_weekday(days_of(make, [20] * 7)).count() == 0


def test_busiest_day(make):
    row = timeline.busiest_weekday(days_of(make, [5, 5, 20, 5, 5, 5, 5])).first()
    assert (row.weekday, row["count"], row.dated_rows) == ("Wednesday", 20, 50)
    assert row.effect == 1.0
    # the same shape with fewer than 30 rows says nothing
    assert timeline.busiest_weekday(days_of(make, [2, 2, 8, 2, 2, 2, 2])).count() == 0


def test_peak_month_needs_two_months(make):
    assert timeline.peak_month(days_of(make, [1] * 20)).count() == 0
    row = timeline.peak_month(days_of(make, [1] * 40)).first()
    assert (row.month, row.calendar_months) == ("January", 2)


def test_months_of_different_years_merge(make):
    rows = [(dt.date(y, m, 1),) for y, m, n in ((2023, 3, 2), (2024, 3, 2), (2024, 5, 3)) for _ in range(n)]
    row = timeline.peak_month(timeline.daily_counts(make(rows, "d date"), "d")).first()
    assert (row.month, row["count"], row.calendar_months) == ("March", 4, 3)


def test_leading_category_has_its_own_day(make):
    monday = dt.date(2026, 1, 5)
    rows = [(monday + dt.timedelta(days=i % 7), "even") for i in range(35)]
    rows += [(monday + dt.timedelta(days=4), "late") for _ in range(40)]
    row = timeline.category_peak_weekday(make(rows, "d date, k string"), "d", "k").first()
    assert (row.label, row.weekday, row["count"], row.label_rows) == ("late", "Friday", 40, 40)


# --- correlation -----------------------------------------------------------------------


def test_perfect_pair_over_complete_rows(make):
    rows = [(float(i), 2.0 * i if i % 4 else None, -float(i), 7.0) for i in range(40)]
    ds = make(rows, "x double, y double, z double, same double")
    pairs = {(r.a, r.b): (r.r, r.n) for r in relations.pairwise_corr(ds, ds.numbers).collect()}
    assert set(pairs) == {("x", "y"), ("x", "z"), ("y", "z")}  # the constant column is left out
    assert pairs["x", "y"] == (pytest.approx(1.0), 30) and pairs["x", "z"] == (pytest.approx(-1.0), 40)


def test_pairs_need_ten_rows(make):
    ds = make([(float(i), float(i)) for i in range(9)], "x double, y double")
    assert relations.corr_top(ds, ds.numbers).count() == 0


def test_many_columns_take_several_scans(make):
    rows = [tuple(float((i * (c + 3)) % 17) for c in range(7)) for i in range(30)]
    ds = make(rows, ", ".join(f"c{i} double" for i in range(7)))
    assert relations.pairwise_corr(ds, ds.numbers).count() == 21
    assert relations.corr_top(ds, ds.numbers).count() == 4


@pytest.mark.parametrize("r, words", [(0.19, "unrelated"), (-0.2, "weakly related"), (0.4, "moderately related"), (-0.7, "strongly related")])
def test_bands(spark, r, words):
    df = spark.range(1).select(relations.relation_words(F.abs(F.lit(r)))[0])
    assert df.first()[0] == words


# --- outliers --------------------------------------------------------------------------


def test_outliers_are_strictly_outside(make):
    values = [100 + i % 5 for i in range(60)] + [9_000, 9_500, 10_000]
    ds = make([(i, v, 5) for i, v in enumerate(values)], "id int, v int, same int")
    row = outliers.outlier_top_columns(ds, ds.numbers).first()
    assert (row.column, row.outliers, row.min_outlier, row.max_outlier) == ("v", 3, 9_000.0, 10_000.0)
    edge = make([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 17]], "v double")
    stats = outliers.outlier_stats(edge, edge.numbers).first()
    assert (stats.q1, stats.q3, stats.upper_fence) == (3.25, 7.75, 14.5) and stats.outliers == 1


def test_no_spread_means_no_fence(make):
    ds = make([(1,)] * 30 + [(9,)], "v int")
    assert outliers.outlier_stats(ds, ds.numbers).count() == 0


# --- change ----------------------------------------------------------------------------


def test_midpoint_of_dates(make):
    ds = make([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 4),)], "d date")
    assert change.time_midpoint(ds, "d").first().midpoint == "2024-01-02T12:00:00"
    assert change.time_midpoint(make([(dt.date(2024, 1, 1),)] * 2, "d date"), "d").count() == 0
    assert change.time_midpoint(make([(None,)], "d date"), "d").count() == 0


def halves(make, counts):
    rows = []
    for label, (first, second) in counts.items():
        rows += [(dt.date(2024, 1, 1), label)] * first + [(dt.date(2024, 1, 3), label)] * second
    ds = make(rows, "d date, k string")
    middle = change.time_midpoint(ds, "d").first().mid_epoch
    return change.half_change(ds, "d", "k", middle)


def test_half_change_with_labels_on_one_side(make):
    found = {r.label: (r.first_half, r.second_half, r.delta) for r in halves(make, {"a": (3, 0), "b": (0, 5), None: (1, 1)}).collect()}
    assert found == {"a": (3, 0, -3), "b": (0, 5, 5), None: (1, 1, 0)}


def test_top_mover_and_leader(make):
    h = halves(make, {"Alpha": (10, 30), "Beta": (10, 10)})
    top = change.top_mover(h).first()
    assert (top.label, top.delta, top.pct, top.effect) == ("Alpha", 20, 200.0, 1.0)
    gap = change.leader_gap(h).first()
    assert (gap.leader, gap.leader_total, gap.second_label, gap.second_total, gap.lead_pct) == ("Alpha", 40, "Beta", 20, 100.0)


def test_no_leader_claim_when_another_group_moved_most(make):
    assert change.leader_gap(halves(make, {"Alpha": (50, 50), "Beta": (5, 30)})).count() == 0
    # 'None' sorts above 'Alpha', so the blank group leads the tie and nothing is claimed
    assert change.leader_gap(halves(make, {"Alpha": (0, 5), None: (5, 0)})).count() == 0


def test_half_volume(make):
    ds = make([(dt.date(2024, 1, d),) for d in (1, 1, 2, 9, 9, 9, 9)], "d date")
    middle = change.time_midpoint(ds, "d").first().mid_epoch
    row = change.half_volume(ds, "d", middle).first()
    assert (row.first_rows, row.second_rows, row.delta, row.effect) == (3, 4, 1, pytest.approx(1 / 3))


# --- long labels -----------------------------------------------------------------------


def test_long_labels_are_grouped_short_and_shown_whole(make):
    long, other = "a long label " * 20, "a long label " * 19 + "with another end"
    rows = [(long, dt.datetime(2024, 1, 1 + i % 20)) for i in range(30)] + [(other, dt.datetime(2024, 1, 20))] * 20 + [("short", dt.datetime(2024, 1, 2))] * 10
    ds = make(rows, "body string, at timestamp_ntz")
    top = concentration.concentration(ds).first()
    assert (top.label, top["count"], top.runner_up, top.distinct_values) == (long, 30, other, 3)
    assert [(r.label, r["count"]) for r in charts.category_counts(ds, "body").collect()] == [(long, 30), (other, 20), ("short", 10)]
    middle = change.time_midpoint(ds, "at").first().mid_epoch
    halves = change.half_change(ds, "at", "body", middle)
    assert {len(r.label) for r in halves.collect()} == {5, 64 + 1 + 64}
    info = ds.column("body")
    assert spelled(ds, info, change.top_mover(halves), "label").first().label == other
    exchanged = [line for line in halves._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanged and not any("body" in line for line in exchanged)
