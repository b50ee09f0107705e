import pytest
from pyspark.sql import functions as F

from veritable import ROW_ID
from veritable.operators import rows
from veritable.operators.rank_index import RankIndex


@pytest.fixture(scope="module")
def table(make):
    values = [5, None, 3, 3, 9, None, 3, 1]
    return make([(v, f"r{i}") for i, v in enumerate(values)], "v int, name string")


def order(df):
    return [row[ROW_ID] for row in df.collect()]


def test_sort_is_stable_with_nulls_last(table):
    assert order(rows.sorted_rows(table, "v", "asc")) == [7, 2, 3, 6, 0, 4, 1, 5]
    assert order(rows.sorted_rows(table, "v", "DESC")) == [4, 0, 2, 3, 6, 7, 1, 5]
    assert order(rows.sorted_rows(table)) == list(range(8))
    with pytest.raises(ValueError):
        rows.sorted_rows(table, "v", "up")
    with pytest.raises(ValueError):
        rows.sorted_rows(table, "zzz")


@pytest.mark.parametrize("sort_by", [None, "v", "name"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_join_to_the_sorted_view(table, sort_by, direction):
    whole = order(rows.sorted_rows(table, sort_by, direction))
    for shallow in (100_000, 1):  # top-k, and seeking
        pages = [rows.page(table, n, 3, sort_by, direction, shallow_rows=shallow) for n in (1, 2, 3, 4)]
        assert [order(p) for p in pages] == [whole[0:3], whole[3:6], whole[6:9], []]


def test_page_arguments(table):
    for number, size in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            rows.page(table, number, size)


def test_deep_page_in_a_hot_value(make):
    """One value holds most rows; the page starts and ends inside it."""
    table = make([(1 if i % 50 else i,) for i in range(2_000)], "v int")
    for direction in ("asc", "desc"):
        whole = order(rows.sorted_rows(table, "v", direction))
        for number in (5, 12, 20):
            page = rows.page(table, number, 100, "v", direction, shallow_rows=50)
            assert order(page) == whole[(number - 1) * 100 : number * 100]


def test_lookup_keeps_order_and_repeats(table):
    found = rows.rows_by_id(table, [6, 2, 99, 6, 0])
    assert order(found) == [6, 2, 6, 0]
    assert order(rows.rows_by_id(table, "6, 2,,0")) == [6, 2, 0]
    with pytest.raises(ValueError):
        rows.rows_by_id(table, "1,x")
    assert rows.rows_by_id(table, []).count() == 0
    with pytest.raises(ValueError, match="240 row ids"):
        rows.rows_by_id(table, list(range(8)) * 30)
    assert rows.rows_by_id(table, list(range(8)) * 30, most=240).count() == 240


def test_lookup_respects_filters(table):
    ds = table.slice([{"col": "v", "op": "eq", "value": 3}])
    assert order(rows.rows_by_id(ds, [0, 6, 2])) == [6, 2]


def test_evidence_and_extremes(table):
    v = table.column("v").ref
    assert rows.evidence_list(table, v == 3) == [2, 3, 6]
    assert rows.evidence_list(table, v == 3, limit=2) == [2, 3]
    sides = [(r.side, r[ROW_ID]) for r in rows.extremes(table, "v", 2).collect()]
    assert sorted(sides) == [("high", 0), ("high", 4), ("low", 2), ("low", 7)]


def test_evidence_of_large_tables_looks_at_a_prefix_first(table, monkeypatch):
    v = table.column("v").ref
    monkeypatch.setattr(rows, "PREFIX_IDS", 4)
    assert rows.evidence_list(table, v == 3, limit=2, rows=8) == [2, 3]
    assert rows.evidence_list(table, v == 3, limit=3, rows=8) == [2, 3, 6]


def test_sample_takes_the_first_rows(table):
    assert order(rows.sample_rows(table, 3).df) == [0, 1, 2]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_rank_index_gives_the_pages_of_a_sort(make, order):
    values = [None if i % 7 == 0 else float("nan") if i % 31 == 0 else float(i * 37 % 11) for i in range(700)]
    ds = make([(v, f"t{i}") for i, v in enumerate(values)], "v double, t string")
    index = RankIndex.build(ds, "v", order, range_rows=60)
    starts = index.ranges.orderBy("part").collect()
    assert sum(r.rows for r in starts) == 700 and len(starts) > 5
    every = [r[ROW_ID] for r in rows.sorted_rows(ds, "v", order).collect()]
    for number in (1, 2, 9, 17, 18, 19):
        got = [r[ROW_ID] for r in index.page(number, 40).collect()]
        assert got == every[(number - 1) * 40 : number * 40], number
    with pytest.raises(ValueError):
        index.page(0)


def test_rank_index_is_cheap_to_use_again(make, spark):
    ds = make([(f"w{i * 7919 % 3000:04d}",) for i in range(3_000)], "w string")
    index = RankIndex.build(ds, "w", range_rows=200)
    for number in (40, 55):
        spark.sparkContext.setJobGroup(f"page{number}", "page")
        page = [r.w for r in index.page(number, 50).collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"page{number}"))
        spark.sparkContext._jsc.clearJobGroup()
        assert page == [f"w{i:04d}" for i in range((number - 1) * 50, number * 50)]
        assert jobs <= 5
    assert RankIndex.build(ds.where(F.lit(False)), "w").page(1).count() == 0
