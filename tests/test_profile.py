import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritable import ROW_ID
from veritable.operators import profile


@pytest.fixture(scope="module")
def messy(make):
    rows = [
        (1, "a", None, dt.date(2024, 1, 1)), (2, "", 2.0, dt.date(2024, 1, 31)), (3, None, 4.0, None),
        (4, "a", None, dt.date(2024, 1, 2)),
    ]
    return make(rows, "n int, s string, x double, d date")


def test_missing_counts_blank_text_too(messy):
    found = {r.column: (r.missing, r.missing_fraction, r.missing_pct) for r in profile.missing_by_column(messy).collect()}
    assert found == {"n": (0, 0.0, 0.0), "s": (2, 0.5, 50.0), "x": (2, 0.5, 50.0), "d": (1, 0.25, 25.0)}
    flagged = [r.column for r in profile.missing_flagged(messy).collect()]
    assert flagged == ["s", "x", "d"]


def test_missing_of_no_rows(messy):
    rows = profile.missing_by_column(messy.slice([{"col": "n", "op": "gte", "value": 99}])).collect()
    assert [(r.missing, r.missing_fraction, r.missing_pct) for r in rows] == [(0, 0.0, 0.0)] * 4


def test_summary(messy):
    found = {r.name: r for r in profile.summary(messy).collect()}
    assert (found["n"].min_number, found["n"].max_number, found["n"].avg) == (1.0, 4.0, 2.5)
    assert (found["d"].min_date, found["d"].max_date) == ("2024-01-01", "2024-01-31")
    assert found["s"].distinct_values == 2 and found["s"].position == 1


def test_key_numbers_sum_beyond_long(make):
    ds = make([(2**62,), (2**62,), (2**62,)], "n long")
    assert profile.key_numbers(ds).first()["sum"] == float(3 * 2**62)


def test_key_numbers_take_six_columns(make):
    ds = make([tuple(range(8))], ", ".join(f"c{i} int" for i in range(8)))
    assert [r.column for r in profile.key_numbers(ds).collect()] == [f"c{i}" for i in range(6)]
    assert profile.key_numbers(make([("a",)], "s string")).count() == 0


def test_wide_tables_take_several_scans(make):
    ds = make([tuple(range(150)), tuple(range(150))], ", ".join(f"c{i} int" for i in range(150)))
    assert profile.missing_by_column(ds).count() == 150
    assert profile.data_quality(ds).first().duplicate_rows == 1


def test_date_range_skips_empty_columns(make):
    moments = [(None, dt.datetime(2024, 1, 1, 20)), (None, dt.datetime(2024, 1, 3, 19))]
    ds = make(moments, "a date, b timestamp_ntz")
    row = profile.date_range(ds).first()
    assert (row.column, row.min, row.span_days) == ("b", "2024-01-01T20:00:00", 1)
    assert profile.date_range(make([(1,)], "n int")).count() == 0


def test_duplicates(make):
    rows = [("x", None, 0.0), ("y", 1, 1.0), ("x", None, -0.0), ("y", 2, 1.0), ("x", None, 0.0)]
    ds = make(rows, "s string, n int, z double")
    assert profile.duplicate_count(ds).first()[0] == 2
    assert [r[ROW_ID] for r in profile.duplicate_rows(ds).collect()] == [2, 4]
    assert profile.duplicate_count(make([("a",), ("b",)], "s string")).first()[0] == 0
    assert profile.duplicate_count(ds.slice([{"col": "s", "op": "eq", "value": "q"}])).first()[0] == 0


def test_duplicates_of_a_hot_row(make):
    """Two thirds of the rows are copies of one row; 25 examples, the first ones."""
    ds = make([("same" if i % 3 else f"u{i}",) for i in range(900)], "s string")
    assert profile.duplicate_count(ds).first()[0] == 599
    want = [i for i in range(900) if i % 3][1:26]
    assert [r[ROW_ID] for r in profile.duplicate_rows(ds).collect()] == want
    plan = profile.duplicate_rows(ds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


def test_duplicate_examples_of_large_tables(make, monkeypatch):
    ds = make([("same" if i % 3 else f"u{i}",) for i in range(300)], "s string")
    whole = [r[0] for r in profile.duplicate_rows(ds).collect()]
    for ids in (10, 100):  # too few repeats at the beginning, and enough
        monkeypatch.setattr(profile, "EXAMPLE_IDS", ids)
        assert [r[0] for r in profile.duplicate_examples(ds, 300).collect()] == whole


def test_maps_can_be_duplicates(make):
    ds = make([({"a": 1},), ({"a": 1},)], "m map<string,int>")
    assert profile.duplicate_count(ds).first()[0] == 1


@pytest.mark.parametrize(
    "values, violations",
    [([1, 2, 3, 4, 5, 6, 7], 0), ([1, 1, 2, 3, 3, 4, 5], 2), ([7, 6, 5, None, 4, 3, 2], 5),
     ([None, None, 1, None, None, None, 2], 0), ([None] * 7, 0), ([1, None, None, None, None, None, 1], 1)],
)
def test_monotonic_violations(make, values, violations):
    ds = make([(v,) for v in values], "v int")
    for block in (1, 2, 3, 100):
        assert profile.monotonic_violations(ds, "v", block).first().violations == violations


def test_identifiers(make):
    rows = [
        # customer_id by name; serial unique; step increasing with gaps; price and small are measures
        (i % 5, 1000 + i, 10 * i if i % 2 else None, i + 0.5, i % 7, (i * 7919) % 100_003)
        for i in range(60)
    ]
    ds = make(rows, "customer_id int, serial long, step int, price double, small int, spread int")
    found = {r.column: r.reason for r in profile.identifier_columns(ds).collect()}
    assert found == {"customer_id": "name", "serial": "unique", "step": "increasing", "spread": "unique"}
    assert [c.name for c in profile.measure_columns(ds)] == ["price", "small"]


def test_data_quality(messy):
    row = profile.data_quality(messy).first()
    assert (row.rows, row.columns, row.numeric_columns, row.date_columns, row.text_columns) == (4, 4, 2, 1, 1)
    assert row.small_sample and row.duplicate_rows == 0 and row.mean_missing == 0.3125


def test_schema_classes(messy):
    found = [(r.name, r.type, r.is_integer, r.row_count) for r in profile.schema_classes(messy).collect()]
    assert found == [("n", "number", True, 4), ("s", "text", False, 4), ("x", "number", False, 4), ("d", "date", False, 4)]


def test_a_unique_column_rules_out_duplicates(make):
    unique = make([(i, "same") for i in range(50)], "n int, s string")
    nearly = make([(min(i, 48), "same") for i in range(50)], "n int, s string")
    for ds, want in ((unique, 0), (nearly, 1)):
        base = profile.aggregate_once(ds, profile.missing_measures(ds), profile.identifier_measures(ds))
        assert profile.has_unique_column(ds, base) == (want == 0)
        assert profile.data_quality(ds).first().duplicate_rows == want


@pytest.mark.parametrize("most", [0, 2, 100_000])
def test_the_sieve_of_hashes_changes_no_count(make, monkeypatch, most):
    """Hot copies, zeros of both signs, NaN, nulls and nested values; also with hashes that meet by chance."""
    nan = float("nan")
    rows = [(1.5, "a", [1, 2])] * 40 + [(0.0, "z", None), (-0.0, "z", None), (nan, None, []), (nan, None, []), (None, "", [None]), (None, None, [None])]
    rows += [(float(i), f"t{i}", [i]) for i in range(60)] + [(7.0, "t7", [7]), (8.0, "t8", None), (None, "a", None), (None, "a", None)]
    ds = make(rows, "v double, t string, l array<int>")
    for few in (False, True):
        if few:
            monkeypatch.setattr(profile, "_row_hash", lambda ds: F.coalesce(F.length(F.col("t")), F.lit(0)).cast("long"))
        assert profile.duplicate_count(ds, most).first().duplicate_rows == 39 + 1 + 1 + 1 + 1
        assert [r[0] for r in profile.duplicate_rows(ds, most).collect()] == [*range(1, 26)]
    late = ds.where(F.col("v").isNull() | (F.col("v") != 1.5))
    assert [r[0] for r in profile.duplicate_rows(late, most).collect()] == [41, 43, 106, 109]


def test_a_table_without_equal_rows_shuffles_hashes_only(spark, make):
    ds = make([(float(i), f"t{i}") for i in range(200)], "v double, t string")
    assert profile.repeated_candidates(ds).df.count() == 0
    assert profile.duplicate_count(ds).first().duplicate_rows == 0


def test_distinct_counts_of_dense_and_sparse_columns_in_one_job(spark, make):
    rows = [(i, i * 10**12, i // 2, None if i % 2 else i, -i, 10**15 + i) for i in range(400)]
    ds = make(rows, "a long, b long, c int, d long, e int, f long")
    seen = profile.aggregate_once(ds, profile.identifier_measures(ds)).first()
    got = profile.distinct_counts(ds, seen, {i: 1 for i in range(6)})
    assert got == {0: 400, 1: 400, 2: 200, 3: 200, 4: 400, 5: 400}
