"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local executor threads (default 8)
    BENCH_UNIFORM  rows of a generated table to run the operators on instead
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from veritable import Dataset, build_session, scratch_path  # noqa: E402
from veritable.operators import charts, outliers, profile, relations, rows, timeline  # noqa: E402
from veritable.plans.report import build_report  # noqa: E402
from veritable.sources.synthetic import uniform_table  # noqa: E402

HEADLINES = [
    "clicks_over_time", "filter_conjunction", "filter_text_contains", "page_query", "page_deep", "rows_by_id",
    "sort_desc", "export_view", "csv_scan", "summary_numeric", "summary_text", "key_numbers", "missing_by_column",
    "data_quality", "duplicate_rows", "identifier_columns", "monotonic_violations", "category_counts",
    "time_series_avg", "time_series_split_grid", "numeric_histogram", "compare_delta", "concentration",
    "trend_verdict", "busiest_weekday", "pairwise_corr", "quartiles", "outlier_stats", "half_change", "findings_all",
]


def timed(run: Callable[[], object], repeat: int = 2) -> float:
    """The best of a few runs, the first of which also compiles the plan."""
    best = float("inf")
    for _ in range(repeat):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def store(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def table_queries(spark, folder: str) -> dict[str, Callable[[], object]]:
    return {name: lambda name=name: store(QUERIES[name](spark, folder)) for name in HEADLINES}


def uniform_queries(spark, count: int) -> dict[str, Callable[[], object]]:
    path = scratch_path(spark, "uniform")
    uniform_table(spark, count, partitions=32).write.parquet(path)
    ds = Dataset.of(spark.read.parquet(path), name="uniform")
    measures = [ds.column("value"), ds.column("id")]
    return {
        "summary": lambda: store(profile.summary(ds)),
        "missing_by_column": lambda: store(profile.missing_by_column(ds)),
        "duplicate_count": lambda: store(profile.duplicate_count(ds)),
        "category_counts": lambda: store(charts.category_counts(ds, "category")),
        "time_series_sum": lambda: store(charts.time_series(ds, "timestamp", "sum", "value")),
        "time_series_grid": lambda: store(charts.time_series_grid(ds, "timestamp", "region")),
        "numeric_histogram": lambda: store(charts.numeric_histogram(ds, "value")),
        "trend": lambda: store(timeline.trend_verdict(timeline.daily_counts(ds, "timestamp"))),
        "pairwise_corr": lambda: store(relations.pairwise_corr(ds, measures)),
        "quartiles": lambda: store(outliers.quartiles(ds, measures)),
        "page_first": lambda: rows.page(ds, 1, 50).collect(),
        "page_deep": lambda: rows.page(ds, count // 100, 50, "value").collect(),
        "rows_by_id": lambda: rows.rows_by_id(ds, [count // 2, 7, count - 1]).collect(),
        "report": lambda: build_report(ds).as_dict(),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    uniform = int(os.environ.get("BENCH_UNIFORM", "0"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1_000).selectExpr("sum(id)").collect()
    todo = uniform_queries(spark, uniform) if uniform else table_queries(spark, folder)
    seconds = {name: timed(run) for name, run in todo.items()}
    result = {
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": f"uniform {uniform}" if uniform else Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
