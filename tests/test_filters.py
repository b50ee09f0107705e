import datetime as dt

import pytest
from pyspark.sql import types as T

from veritable import Dataset
from veritable.schema import ColumnInfo, describe, kind_of, named_like_identifier, ref


@pytest.fixture(scope="module")
def table(make):
    rows = [
        (1, 1.5, "Alpha", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 8)),
        (2, None, "alphabet", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 8)),
        (3, -2.0, "100%", dt.date(2024, 1, 3), None),
        (0, 0.0, "a\\b", None, dt.datetime(2024, 1, 4, 8)),
        (None, 7.0, None, dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 8)),
    ]
    return make(rows, "n int, x double, s string, d date, ts timestamp_ntz")


def ids(ds):
    return sorted(row["__rowid"] for row in ds.df.select("__rowid").collect())


@pytest.mark.parametrize(
    "col, op, value, want",
    [
        ("n", "eq", 0, [3]),
        ("n", "eq", "2", [1]),
        ("n", "eq", 2.5, []),
        ("n", "neq", 2, [0, 2, 3]),
        ("n", "neq", 2.5, [0, 1, 2, 3]),
        ("n", "gte", 1.5, [1, 2]),
        ("n", "lte", 1.5, [0, 3]),
        ("n", "lte", 1e300, [0, 1, 2, 3]),
        ("x", "gte", 0, [0, 3, 4]),
        ("s", "eq", "Alpha", [0]),
        ("s", "neq", "Alpha", [1, 2, 3]),
        ("s", "contains", "ALPHA", [0, 1]),
        ("s", "contains", "0_%", [2]),
        ("s", "contains", "\\", [3]),
        ("d", "gte", "2024-01-02", [1, 2, 4]),
        ("d", "gte", "2024-01-02T01:00:00", [2, 4]),
        ("d", "lte", "2024-01-02T01:00:00", [0, 1]),
        ("ts", "gte", "2024-01-02 08:00:00", [1, 3, 4]),
        ("ts", "lte", "2024-01-02T08:00:00Z", [0, 1]),
    ],
)
def test_single_filters(table, col, op, value, want):
    assert ids(table.slice([{"col": col, "op": op, "value": value}])) == want


def test_items_without_column_or_value_are_skipped(table):
    filters = [
        {"col": None, "op": "eq", "value": 1}, {"col": "n", "op": "eq", "value": ""},
        {"col": "n", "op": "eq", "value": None}, {"col": "x", "op": "gte", "value": 0},
    ]
    assert ids(table.slice(filters)) == [0, 3, 4]
    assert ids(table.slice(None)) == ids(table.slice("")) == ids(table.slice("[]")) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    "filters",
    [
        "not json", '{"col": "n"}', "[1]",
        [{"col": "zzz", "op": "eq", "value": 1}],
        [{"col": "n", "op": "contains", "value": 1}],
        [{"col": "s", "op": "gte", "value": "a"}],
        [{"col": "d", "op": "eq", "value": "2024-01-01"}],
        [{"col": "n", "op": "eq", "value": "abc"}],
        [{"col": "d", "op": "gte", "value": "soon"}],
    ],
)
def test_bad_filters_are_refused(table, filters):
    with pytest.raises(ValueError):
        table.slice(filters)


def test_comparisons_reach_the_parquet_scan(spark, tmp_path, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    table.df.write.parquet(str(tmp_path / "t"))
    ds = Dataset.of(spark.read.parquet(str(tmp_path / "t"))).slice(
        [{"col": "n", "op": "gte", "value": 1.5}, {"col": "d", "op": "lte", "value": "2024-01-04"},
         {"col": "ts", "op": "gte", "value": "2024-01-01"}, {"col": "s", "op": "neq", "value": "x"}]
    )
    plan = ds.df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("GreaterThanOrEqual(n,2)", "LessThanOrEqual(d,2024-01-04)", "GreaterThanOrEqual(ts,",
                 "Not(EqualTo(s,x))"):
        assert part in pushed


def test_column_classes():
    kinds = {
        "number": [T.ByteType(), T.LongType(), T.DoubleType(), T.DecimalType(10, 2)],
        "date": [T.DateType(), T.TimestampType(), T.TimestampNTZType()],
        "text": [T.StringType(), T.BooleanType(), T.BinaryType(), T.ArrayType(T.LongType()),
                 T.DayTimeIntervalType()],
    }
    for kind, types in kinds.items():
        assert {kind_of(t) for t in types} == {kind}
    assert not ColumnInfo("x", "number", T.DoubleType()).is_integer


def test_identifier_names():
    yes = ["id", "ID", "user_id", "row index", "order-key", "UUID", "my.key.x"]
    no = ["orderkey", "idea", "paid", "indexed", "identity"]
    assert all(named_like_identifier(n) for n in yes)
    assert not any(named_like_identifier(n) for n in no)


def test_odd_column_names(make, spark):
    df = spark.createDataFrame([(1, "x", 0)], "`a.b` int, `c``d` string, __rowid long")
    ds = Dataset.of(df)
    assert [c.name for c in describe(df.schema)] == ["a.b", "c`d"]
    assert ds.df.select(ref("a.b"), ref("c`d")).first() == (1, "x")
    assert ds.slice([{"col": "a.b", "op": "eq", "value": 1}]).count_rows() == 1
