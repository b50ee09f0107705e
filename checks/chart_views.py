"""Charts and comparisons."""

from pyspark.sql import functions as F

from checks.registry import GAPPY_EVENTS, derive, gappy_events, iso_bucket, iso_sql, load, query
from veritable.operators import charts, compare


@query(
    "category_counts",
    f"WITH {GAPPY_EVENTS} SELECT event_type AS label, count(*) AS count FROM gappy GROUP BY 1 "
    "ORDER BY 2 DESC, 1 NULLS LAST LIMIT 50",
)
def category_counts(spark, folder):
    return charts.category_counts(gappy_events(spark, folder), "event_type")


@query(
    "category_counts_tied",
    "SELECT CAST(o_custkey AS VARCHAR) AS label, count(*) AS count FROM orders GROUP BY 1 "
    "ORDER BY 2 DESC, 1 NULLS LAST LIMIT 50",
)
def category_counts_tied(spark, folder):
    return charts.category_counts(load(spark, folder, "orders"), "o_custkey")


_INTERVAL = """CASE WHEN span / 3600 <= 2000 THEN 'hour' WHEN span / 86400 <= 2000 THEN 'day'
  WHEN span / 604800 <= 2000 THEN 'week' WHEN span / 2592000 <= 2000 THEN 'month' ELSE 'year' END"""


def _interval_sql(table, column):
    return (
        f"SELECT '{column}' AS \"column\", span AS span_seconds, {_INTERVAL} AS interval FROM "
        f"(SELECT greatest((epoch_us(max({column})) - epoch_us(min({column}))) / 1e6, 1.0) AS span FROM {table})"
    )


@query("auto_interval", _interval_sql("events", "ts") + " UNION ALL " + _interval_sql("orders", "o_orderdate"))
def auto_interval(spark, folder):
    first = charts.auto_interval(load(spark, folder, "events"), "ts")
    return first.unionByName(charts.auto_interval(load(spark, folder, "orders"), "o_orderdate"))


def _series_sql(table, column, interval, value, where=""):
    start = f"CAST(date_trunc('{interval}', {column}) AS TIMESTAMP)"
    return f"SELECT {iso_sql(start)} AS bucket, {value} AS value FROM {table} {where} GROUP BY 1"


@query("time_series_count", _series_sql("events", "ts", "hour", "CAST(count(*) AS DOUBLE)"))
def time_series_count(spark, folder):
    return iso_bucket(charts.time_series(load(spark, folder, "events"), "ts"))


@query(
    "time_series_avg",
    _series_sql("orders", "o_orderdate", "month", "round(avg(o_totalprice), 4)"),
)
def time_series_avg(spark, folder):
    ds = load(spark, folder, "orders")
    return iso_bucket(charts.time_series(ds, "o_orderdate", "avg", "o_totalprice", "month"))


@query(
    "time_series_sum",
    _series_sql("events", "ts", "day", "CAST(sum(user_id) AS DOUBLE)", "WHERE event_type <> 'view'"),
)
def time_series_sum(spark, folder):
    ds = load(spark, folder, "events").slice([{"col": "event_type", "op": "neq", "value": "view"}])
    return iso_bucket(charts.time_series(ds, "ts", "sum", "user_id", "day"))


@query("time_series_week", _series_sql("orders", "o_orderdate", "week", "CAST(count(*) AS DOUBLE)"))
def time_series_week(spark, folder):
    return iso_bucket(charts.time_series(load(spark, folder, "orders"), "o_orderdate", interval="week"))


_SPLIT_BUCKET = iso_sql("CAST(date_trunc('day', ts) AS TIMESTAMP)")


@query(
    "time_series_split",
    f"WITH {GAPPY_EVENTS} SELECT {_SPLIT_BUCKET} AS bucket, coalesce(event_type, '(blank)') AS key, "
    "round(sum(value), 2) AS value FROM gappy GROUP BY 1, 2",
)
def time_series_split(spark, folder):
    ds = gappy_events(spark, folder)
    series = charts.time_series_split(ds, "ts", "event_type", "sum", "value", "day")
    return iso_bucket(series).withColumn("value", F.round("value", 2))


_TOP_USERS = (
    "top AS (SELECT CAST(user_id AS VARCHAR) AS key FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), "
    f"b AS (SELECT event_id, {_SPLIT_BUCKET} AS bucket, CAST(user_id AS VARCHAR) AS key FROM events), "
    "hits AS (SELECT b.bucket, b.key FROM b JOIN top ON b.key = top.key)"
)


@query(
    "time_series_split_grid",
    f"WITH {_TOP_USERS}, counts AS (SELECT bucket, key, CAST(count(*) AS DOUBLE) AS value FROM hits GROUP BY 1, 2) "
    "SELECT buckets.bucket, top.key, counts.value FROM (SELECT DISTINCT bucket FROM hits) buckets "
    "CROSS JOIN top LEFT JOIN counts ON counts.bucket = buckets.bucket AND counts.key = top.key",
)
def time_series_split_grid(spark, folder):
    ds = load(spark, folder, "events")
    return iso_bucket(charts.time_series_grid(ds, "ts", "user_id", interval="day"))


def _histogram_sql(table, column, where="TRUE"):
    return f"""WITH s AS (SELECT {column} AS v FROM {table} WHERE {where} AND {column} IS NOT NULL),
m AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS width FROM s),
c AS (SELECT least(29, CAST(floor((v - lo) / width) AS INTEGER)) AS bin, count(*) AS n FROM s, m GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * width, 6) AS bin_start,
  round(lo + r.bin * width + width, 6) AS bin_end, coalesce(c.n, 0) AS count
FROM range(30) r(bin) CROSS JOIN m LEFT JOIN c ON c.bin = r.bin"""


@query("numeric_histogram", _histogram_sql("orders", "o_totalprice"))
def numeric_histogram(spark, folder):
    return charts.numeric_histogram(load(spark, folder, "orders"), "o_totalprice").drop("label")


@query("numeric_histogram_filtered", _histogram_sql("events", "value", "event_type = 'click'"))
def numeric_histogram_filtered(spark, folder):
    ds = load(spark, folder, "events").slice([{"col": "event_type", "op": "eq", "value": "click"}])
    return charts.numeric_histogram(ds, "value").drop("label")


@query(
    "histogram_nan",
    """WITH s AS (SELECT value AS v FROM events WHERE event_type <> 'error'),
m AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS width FROM s),
c AS (SELECT least(29, CAST(floor((v - lo) / width) AS INTEGER)) AS bin, count(*) AS n FROM s, m GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * width, 6) AS bin_start,
  round(lo + r.bin * width + width, 6) AS bin_end, coalesce(c.n, 0) AS count,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS nan_rows
FROM range(30) r(bin) CROSS JOIN m LEFT JOIN c ON c.bin = r.bin""",
)
def histogram_nan(spark, folder):
    """NaN stays out of the bins and is counted apart."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    ds = derive(load(spark, folder, "events"), value=value)
    lost = charts.nan_count(ds, "value").first().nan_rows
    return charts.numeric_histogram(ds, "value").drop("label").withColumn("nan_rows", F.lit(lost))


# --- compare ---------------------------------------------------------------------------

_BASE = "o_orderdate <= TIMESTAMP '1997-12-31'"
_CURRENT = "o_orderdate >= TIMESTAMP '1998-01-01'"


def _halves(spark, folder):
    ds = load(spark, folder, "orders")
    base = ds.slice([{"col": "o_orderdate", "op": "lte", "value": "1997-12-31"}])
    return base, ds.slice([{"col": "o_orderdate", "op": "gte", "value": "1998-01-01"}])


@query(
    "compare_total",
    f"SELECT count(*) AS row_count, round(sum(o_totalprice), 2) AS total FROM orders WHERE {_BASE}",
)
def compare_total(spark, folder):
    base, _ = _halves(spark, folder)
    total = compare.compare_total(base, "sum", "o_totalprice")
    return total.withColumn("total", F.round("total", 2))


@query(
    "compare_series",
    f"WITH {GAPPY_EVENTS} " + _series_sql("gappy", "ts", "day", "coalesce(round(avg(value), 4), 0)"),
)
def compare_series(spark, folder):
    ds = gappy_events(spark, folder)
    return iso_bucket(compare.compare_series(ds, "ts", "avg", "value", "day"))


@query(
    "compare_drivers",
    f"WITH {GAPPY_EVENTS} SELECT coalesce(label, 'Blank') AS label, coalesce(round(m, 2), 0) AS value FROM ("
    "SELECT event_type AS label, sum(value) AS m FROM gappy GROUP BY 1 "
    "ORDER BY abs(m) DESC NULLS LAST, label NULLS LAST LIMIT 30)",
)
def compare_drivers(spark, folder):
    drivers = compare.compare_drivers(gappy_events(spark, folder), "event_type", "sum", "value")
    return drivers.withColumn("value", F.round("value", 2))


def _delta_sql(table, dimension, base, current, value):
    return f"""b AS (SELECT CAST({dimension} AS VARCHAR) AS label, {value} AS v FROM {table} WHERE {base} GROUP BY 1),
c AS (SELECT CAST({dimension} AS VARCHAR) AS label, {value} AS v FROM {table} WHERE {current} GROUP BY 1),
j AS (SELECT coalesce(b.label, c.label, 'Blank') AS label, coalesce(round(b.v, 4), 0.0) AS base_value,
    coalesce(round(c.v, 4), 0.0) AS current_value FROM b FULL JOIN c ON b.label IS NOT DISTINCT FROM c.label),
d AS (SELECT *, round(current_value - base_value, 4) AS delta FROM j),
r AS (SELECT label, CAST(base_value AS DOUBLE) AS base_value, CAST(current_value AS DOUBLE) AS current_value,
  CAST(delta AS DOUBLE) AS delta,
  CAST(round(CASE WHEN base_value <> 0 THEN 100 * delta / abs(base_value) END, 2) + 0.0 AS DOUBLE) AS pct_change FROM d)"""


@query(
    "compare_delta",
    "WITH " + _delta_sql("orders", "o_custkey", _BASE, _CURRENT, "sum(o_totalprice)")
    + " SELECT label, base_value, current_value, round(delta, 2) AS delta, pct_change FROM r",
)
def compare_delta(spark, folder):
    base, current = _halves(spark, folder)
    found = compare.compare_delta(base, current, "o_custkey", "sum", "o_totalprice")
    return found.withColumn("delta", F.round("delta", 2))


@query(
    "compare_top_movers",
    "WITH " + _delta_sql("orders", "o_custkey", _BASE, _CURRENT, "count(*)")
    + " SELECT * FROM r ORDER BY abs(delta) DESC, label LIMIT 6",
)
def compare_top_movers(spark, folder):
    return compare.compare_top_movers(*_halves(spark, folder), "o_custkey")


@query(
    "compare_reason",
    "WITH " + _delta_sql("orders", "o_orderpriority", _BASE, _CURRENT, "count(*)")
    + f""", t AS (SELECT CAST(count(*) FILTER (WHERE {_BASE}) AS DOUBLE) AS base_total,
  CAST(count(*) FILTER (WHERE {_CURRENT}) AS DOUBLE) AS current_total FROM orders),
m AS (SELECT * FROM r ORDER BY abs(delta) DESC, label LIMIT 1)
SELECT base_total, current_total, current_total - base_total AS delta,
  round(100 * (current_total - base_total) / base_total, 2) AS pct_change, label AS top_mover FROM t, m""",
)
def compare_reason(spark, folder):
    reason = compare.compare_reason(*_halves(spark, folder), "o_orderpriority")
    return reason.drop("reason")


# --- flagship --------------------------------------------------------------------------


@query(
    "clicks_over_time",
    _series_sql("events", "ts", "hour", "CAST(count(*) AS DOUBLE)", "WHERE event_type = 'click'"),
)
def clicks_over_time(spark, folder):
    ds = load(spark, folder, "events").slice('[{"col": "event_type", "op": "eq", "value": "click"}]')
    return iso_bucket(charts.time_series(ds, "ts"))
