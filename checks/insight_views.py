"""Insight operators: concentration, trend, rhythm, correlation, outliers, change."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.profiles import lineitem
from checks.registry import (
    ACTIVITY, GAPPY_EVENTS, activity, derive, gappy_events, iso_sql, load, query,
)
from veritable import ROW_ID, Dataset
from veritable.functions.times import iso_text
from veritable.operators import change, concentration, outliers, relations, timeline

# --- concentration ---------------------------------------------------------------------


def labels_sql(table, columns):
    """Leader, runner-up, total and distinct values of text columns."""
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS label, count(*) AS n FROM {table} GROUP BY {c}" for c in columns
    )
    return f"""counts AS ({counts}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, label NULLS LAST) AS place FROM counts),
totals AS (SELECT col, CAST(sum(n) AS BIGINT) AS total, count(label) AS distinct_values FROM counts GROUP BY col),
rivals AS (SELECT col, arg_min(label, place) AS label, arg_min(n, place) AS n FROM ranked
  WHERE place BETWEEN 2 AND 3 AND label IS NOT NULL GROUP BY col),
leaders AS (SELECT r.col AS "column", r.label, r.n AS count, t.total, r.n / t.total AS share, t.distinct_values,
  v.label AS runner_up, v.n AS runner_up_count, v.n / t.total AS runner_up_share
  FROM ranked r JOIN totals t ON t.col = r.col LEFT JOIN rivals v ON v.col = r.col
  WHERE r.place = 1 AND r.label IS NOT NULL),
reported AS (SELECT * FROM leaders ORDER BY share DESC, "column" DESC LIMIT 2)"""


_SHARES = (
    '"column", label, count, total, round(share, 6) AS share, distinct_values, '
    "runner_up, runner_up_count, round(runner_up_share, 6) AS runner_up_share"
)


def _rounded(df):
    return df.withColumns(
        {c: F.round(c, 6) for c in ("share", "runner_up_share") if c in df.columns}
    )


@query(
    "concentration",
    f"WITH {labels_sql('documents', ['text', 'lang', 'source'])} SELECT {_SHARES} FROM leaders",
)
def concentration_all(spark, folder):
    return _rounded(concentration.concentration(load(spark, folder, "documents")))


@query(
    "concentration_blank_leader",
    f"WITH d AS (SELECT text, nullif(lang, 'en') AS lang, source FROM documents), "
    f"{labels_sql('d', ['text', 'lang', 'source'])} SELECT {_SHARES} FROM leaders",
)
def concentration_blank_leader(spark, folder):
    ds = derive(load(spark, folder, "documents"), lang=F.nullif("lang", F.lit("en")))
    return _rounded(concentration.concentration(ds))


_ACTIVITY_LABELS = f"WITH {ACTIVITY}, {labels_sql('activity', ['kind', 'channel', 'status'])}"


@query(
    "concentration_flagged",
    f"{_ACTIVITY_LABELS} SELECT {_SHARES} FROM reported WHERE distinct_values > 1 AND share >= 0.40",
)
def concentration_flagged(spark, folder):
    return _rounded(concentration.concentration_flagged(activity(spark, folder)))


@query(
    "single_value_columns",
    f'{_ACTIVITY_LABELS} SELECT "column", label AS only_value, count, distinct_values FROM reported '
    "WHERE distinct_values <= 1",
)
def single_value_columns(spark, folder):
    return concentration.single_value_columns(activity(spark, folder))


@query(
    "concentration_runner_up",
    f"WITH {GAPPY_EVENTS}, {labels_sql('gappy', ['event_type', 'props'])} "
    'SELECT "column", runner_up, runner_up_count, round(runner_up_share, 6) AS runner_up_share FROM leaders',
)
def concentration_runner_up(spark, folder):
    found = _rounded(concentration.concentration(gappy_events(spark, folder)))
    return found.select("column", "runner_up", "runner_up_count", "runner_up_share")


# --- time line -------------------------------------------------------------------------

_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


@query("daily_counts", f"SELECT {iso_sql(_DAY)} AS day, count(*) AS count FROM events GROUP BY 1")
def daily_counts(spark, folder):
    days = timeline.daily_counts(load(spark, folder, "events"), "ts")
    return days.withColumn("day", iso_text(F.col("day")))


def fit_sql(table, column, where="TRUE"):
    return f"""days AS (SELECT date_trunc('day', {column}) AS day, count(*) AS n FROM {table}
  WHERE {column} IS NOT NULL AND {where} GROUP BY 1),
points AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS x FROM days),
fit AS (SELECT count(*) AS buckets, regr_slope(n, x) AS slope, regr_intercept(n, x) AS intercept,
  CASE WHEN var_pop(n) = 0 THEN 0 ELSE greatest(0, regr_r2(n, x)) END AS r_squared,
  arg_min(n, day) AS first_count, arg_max(n, day) AS last_count, CAST(sum(n) AS BIGINT) AS dated_rows FROM points),
verdict AS (SELECT *, CASE WHEN r_squared < 0.30 OR round(slope, 2) = 0 THEN 'flat'
    WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  CASE WHEN r_squared >= 0.8 THEN 'very consistent' WHEN r_squared >= 0.5 THEN 'fairly consistent'
    ELSE 'rough' END AS steadiness FROM fit WHERE buckets >= 3)"""


_FIT = (
    "buckets, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, "
    "first_count, last_count, dated_rows"
)


def _fit(df):
    return df.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r_squared")})


@query("trend_fit", f"WITH {fit_sql('orders', 'o_orderdate')} SELECT {_FIT} FROM fit")
def trend_fit(spark, folder):
    return _fit(timeline.trend_fit(timeline.daily_counts(load(spark, folder, "orders"), "o_orderdate")))


@query("trend_verdict", f"WITH {fit_sql('events', 'ts')} SELECT {_FIT}, direction, steadiness FROM verdict")
def trend_verdict(spark, folder):
    return _fit(timeline.trend_verdict(timeline.daily_counts(load(spark, folder, "events"), "ts")))


# every order is dated by the square root of its place, so that days fill up steadily
_GROWING = (
    "growing AS (SELECT o_orderkey, o_totalprice, TIMESTAMP '2024-01-01' + to_days(CAST(floor(sqrt(o_orderkey)) "
    "AS INTEGER)) AS o_orderdate FROM orders)"
)


@query(
    "trend_verdict_clear",
    f"WITH {_GROWING}, {fit_sql('growing', 'o_orderdate')} SELECT {_FIT}, direction, steadiness FROM verdict",
)
def trend_verdict_clear(spark, folder):
    day = F.floor(F.sqrt("o_orderkey")).cast("int")
    moment = F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp_ntz")
    ds = derive(load(spark, folder, "orders"), o_orderdate=moment)
    return _fit(timeline.trend_verdict(timeline.daily_counts(ds, "o_orderdate")))


@query("weekday_counts", "SELECT dayname(ts) AS weekday, count(*) AS count FROM events GROUP BY 1")
def weekday_counts(spark, folder):
    return timeline.weekday_counts(timeline.daily_counts(load(spark, folder, "events"), "ts"))


def busiest_sql(table):
    return f"""wd AS (SELECT dayname(ts) AS weekday, count(*) AS count FROM {table} WHERE ts IS NOT NULL GROUP BY 1),
busy AS (SELECT weekday, count, CAST((SELECT sum(count) FROM wd) AS BIGINT) AS dated_rows FROM wd
  ORDER BY count DESC, weekday LIMIT 1),
busiest AS (SELECT *, count / dated_rows AS share,
  greatest(0.0, least(1.0, count / dated_rows * 7.0 - 1.0)) AS effect FROM busy
  WHERE dated_rows >= 30 AND count / dated_rows >= 1.3 * (1.0 / 7.0))"""


_BUSIEST = "weekday, count, dated_rows, round(share, 6) AS share, round(effect, 6) AS effect"


def _busiest(days):
    return timeline.busiest_weekday(days).withColumns({c: F.round(c, 6) for c in ("share", "effect")})


@query("busiest_weekday", f"WITH {ACTIVITY}, {busiest_sql('activity')} SELECT {_BUSIEST} FROM busiest")
def busiest_weekday(spark, folder):
    return _busiest(timeline.daily_counts(activity(spark, folder), "ts"))


@query("busiest_weekday_even", f"WITH {busiest_sql('events')} SELECT {_BUSIEST} FROM busiest")
def busiest_weekday_even(spark, folder):
    return _busiest(timeline.daily_counts(load(spark, folder, "events"), "ts"))


@query(
    "peak_month",
    "SELECT monthname(o_orderdate) AS month, count(*) AS count, "
    "(SELECT count(DISTINCT date_trunc('month', o_orderdate)) FROM orders) AS calendar_months "
    "FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def peak_month(spark, folder):
    return timeline.peak_month(timeline.daily_counts(load(spark, folder, "orders"), "o_orderdate"))


def _own_day_sql(table, category):
    return f"""lead AS (SELECT {category} AS label, count(*) AS label_rows FROM {table} WHERE ts IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 1),
own AS (SELECT l.label, l.label_rows, dayname(a.ts) AS weekday, count(*) AS count FROM {table} a
  JOIN lead l ON a.{category} = l.label GROUP BY ALL ORDER BY count DESC, weekday LIMIT 1),
own_day AS (SELECT '{category}' AS "column", label, label_rows, weekday, count FROM own
  WHERE label_rows >= 30 AND count / label_rows >= 1.3 * (1.0 / 7.0))"""


@query("category_peak_weekday", f"WITH {ACTIVITY}, {_own_day_sql('activity', 'channel')} SELECT * FROM own_day")
def category_peak_weekday(spark, folder):
    return timeline.category_peak_weekday(activity(spark, folder), "ts", "channel")


# --- correlation -----------------------------------------------------------------------

_LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def pairs_sql(table, columns):
    """r and n of all pairs that vary, by position in schema order."""
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS position, '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 "
        f"THEN NULL ELSE corr({a}, {b}) END AS r, count(*) AS n FROM {table} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, (a, b) in enumerate(combinations(columns, 2))
    )
    return f"pairs AS (SELECT * FROM ({pairs}) WHERE n >= 10 AND r IS NOT NULL)"


@query(
    "pairwise_corr",
    f"WITH {pairs_sql('lineitem', _LINE_MEASURES)} SELECT a, b, round(r, 4) + 0.0 AS r, n FROM pairs",
)
def pairwise_corr(spark, folder):
    ds = lineitem(spark, folder)
    found = relations.pairwise_corr(ds, [ds.column(c) for c in _LINE_MEASURES])
    return found.select("a", "b", (F.round("r", 4) + 0.0).alias("r"), "n")


_WIDE = 20


def _wide_sql():
    """Twenty columns of lineitem: rounded, shifted and gappy mixtures of four measures, one of them constant."""
    cells = []
    for i in range(_WIDE):
        a, b = _LINE_MEASURES[i % 4], _LINE_MEASURES[(i // 4 + 1) % 4]
        value = f"CAST({a} AS DOUBLE) * {i + 1} - CAST({b} AS DOUBLE) * {i % 3} + {i * 1000}" if i else "7.5"
        cells.append(f"CASE WHEN l_orderkey % {i + 5} <> 0 THEN {value} END AS w{i}")
    return f"wide AS (SELECT {', '.join(cells)} FROM lineitem)", cells


@query(
    "pairwise_corr_wide",
    f"WITH {_wide_sql()[0]}, {pairs_sql('wide', [f'w{i}' for i in range(_WIDE)])} SELECT a, b, round(r, 4) + 0.0 AS r, n FROM pairs",
)
def pairwise_corr_wide(spark, folder):
    """190 pairs with gaps of their own, from one scan."""
    ds = lineitem(spark, folder)
    wide = Dataset.of(ds.df.selectExpr(ROW_ID, *_wide_sql()[1]), name="wide")
    found = relations.pairwise_corr(wide, list(wide.columns))
    return found.select("a", "b", (F.round("r", 4) + 0.0).alias("r"), "n")


_CORR_COLUMNS = ["value", "score", "doubled", "flat"]
_CORR_TABLE = (
    f"{ACTIVITY}, related AS (SELECT value, CASE WHEN value <= 100 THEN score END AS score, "
    "value * value - 40 * value AS doubled, 7 AS flat FROM activity)"
)


@query(
    "corr_top",
    f"""WITH {_CORR_TABLE}, {pairs_sql('related', _CORR_COLUMNS)}
SELECT a, b, round(r, 4) + 0.0 AS r, n,
  CASE WHEN abs(r) < 0.2 THEN 'unrelated' WHEN abs(r) < 0.4 THEN 'weakly related'
    WHEN abs(r) < 0.7 THEN 'moderately related' ELSE 'strongly related' END AS relation,
  abs(r) < 0.2 AS all_clear FROM pairs ORDER BY abs(r) DESC, position LIMIT 4""",
)
def corr_top(spark, folder):
    value = F.col("value")
    ds = derive(
        activity(spark, folder), score=F.when(value <= 100, F.col("score")),
        doubled=value * value - 40 * value, flat=F.lit(7),
    )
    top = relations.corr_top(ds, [ds.column(c) for c in _CORR_COLUMNS])
    return top.select("a", "b", (F.round("r", 4) + 0.0).alias("r"), "n", "relation", "all_clear")


# --- outliers --------------------------------------------------------------------------


def _quartiles_sql(table, columns):
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.75) AS q3, count({c}) AS \"values\" FROM {table}"
        for i, c in enumerate(columns)
    )
    return f"quart AS ({rows})"


_QUARTILES = 'position, "column", round(q1, 4) AS q1, round(q3, 4) AS q3, "values"'


def _round4(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("quartiles", f"WITH {_quartiles_sql('lineitem', _LINE_MEASURES)} SELECT {_QUARTILES} FROM quart")
def quartiles(spark, folder):
    ds = lineitem(spark, folder)
    return _round4(outliers.quartiles(ds, [ds.column(c) for c in _LINE_MEASURES]), "q1", "q3")


@query(
    "quartiles_selected",
    f"WITH {GAPPY_EVENTS}, {_quartiles_sql('gappy', ['value', 'user_id'])} SELECT {_QUARTILES} FROM quart",
)
def quartiles_selected(spark, folder):
    # a low buffer limit sends these columns through ranked selection
    ds = gappy_events(spark, folder)
    columns = [ds.column(c) for c in ("value", "user_id")]
    return _round4(outliers.quartiles(ds, columns, buffer_rows=200), "q1", "q3")


NAN_EVENTS = """sized AS (SELECT event_id, event_type,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, event_type = 'error' AS lost FROM events)"""


def nan_events(spark, folder):
    """Events whose value is NaN for errors."""
    return derive(load(spark, folder, "events"), value=F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))


@query(
    "quartiles_nan",
    f"WITH {NAN_EVENTS}, {_quartiles_sql('sized', ['value'])}, b AS (SELECT unnest([200, 1000000]) AS buffer_rows) "
    f"SELECT buffer_rows, {_QUARTILES} FROM quart, b",
)
def quartiles_nan(spark, folder):
    """NaN is no value, on both ways of finding quartiles."""
    ds = nan_events(spark, folder)
    parts = [
        _round4(outliers.quartiles(ds, [ds.column("value")], buffer_rows=n), "q1", "q3").withColumn("buffer_rows", F.lit(n))
        for n in (200, 1_000_000)
    ]
    return parts[0].unionByName(parts[1])


def outliers_sql(table, columns):
    stats = " UNION ALL ".join(
        f"""SELECT position, "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
  q3 + 1.5 * (q3 - q1) AS upper_fence, "values",
  (SELECT count(*) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
  (SELECT min({c}) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS min_outlier,
  (SELECT max({c}) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS max_outlier
  FROM quart WHERE "column" = '{c}' AND q3 > q1"""
        for c in columns
    )
    return f"{_quartiles_sql(table, columns)}, stats AS ({stats})"


_STATS = (
    'position, "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, '
    "round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence, outliers, \"values\", "
    'round(outliers / "values", 6) AS fraction, CAST(min_outlier AS DOUBLE) AS min_outlier, '
    "CAST(max_outlier AS DOUBLE) AS max_outlier"
)


def _stats(df):
    rounded = _round4(df, "q1", "q3", "iqr", "lower_fence", "upper_fence")
    return rounded.withColumn("fraction", F.round("fraction", 6))


@query("outlier_stats", f"WITH {outliers_sql('events', ['user_id', 'value'])} SELECT {_STATS} FROM stats")
def outlier_stats(spark, folder):
    ds = load(spark, folder, "events")
    return _stats(outliers.outlier_stats(ds, [ds.column(c) for c in ("user_id", "value")]))


@query(
    "outlier_top_columns",
    f"""WITH {outliers_sql('documents', ['doc_id', 'n_chars'])} SELECT {_STATS} FROM stats WHERE outliers > 0
ORDER BY outliers / "values" DESC, position LIMIT 3""",
)
def outlier_top_columns(spark, folder):
    ds = load(spark, folder, "documents")
    return _stats(outliers.outlier_top_columns(ds, ds.numbers))


# --- change between halves -------------------------------------------------------------


def _mid_sql(table, column):
    return f"""ends AS (SELECT min(epoch({column})) AS first_epoch, max(epoch({column})) AS last_epoch FROM {table}),
mid AS (SELECT first_epoch, last_epoch, (first_epoch + last_epoch) / 2.0 AS mid_epoch FROM ends
  WHERE last_epoch > first_epoch)"""


@query(
    "time_midpoint",
    f"WITH {_mid_sql('events', 'ts')} SELECT round(first_epoch, 4) AS first_epoch, "
    "round(last_epoch, 4) AS last_epoch, round(mid_epoch, 4) AS mid_epoch, "
    "strftime(make_timestamp(CAST(floor(mid_epoch) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS midpoint FROM mid",
)
def time_midpoint(spark, folder):
    found = change.time_midpoint(load(spark, folder, "events"), "ts")
    rounded = _round4(found, "first_epoch", "last_epoch", "mid_epoch")
    return rounded.withColumn("midpoint", F.substring("midpoint", 1, 19))


def halves_sql(table, column, dimension):
    return f"""{_mid_sql(table, column)},
halves AS (SELECT {dimension} AS label, count(*) FILTER (WHERE epoch({column}) < mid_epoch) AS first_half,
  count(*) FILTER (WHERE epoch({column}) >= mid_epoch) AS second_half FROM {table}, mid
  WHERE {column} IS NOT NULL GROUP BY 1),
moved AS (SELECT *, second_half - first_half AS delta FROM halves)"""


def _half_change(ds, date, dimension):
    middle = change.time_midpoint(ds, date).first().mid_epoch
    return change.half_change(ds, date, dimension, middle)


@query("half_change", f"WITH {GAPPY_EVENTS}, {halves_sql('gappy', 'ts', 'event_type')} SELECT * FROM moved")
def half_change(spark, folder):
    return _half_change(gappy_events(spark, folder), "ts", "event_type")


_TOP_MOVER = """SELECT label, first_half, second_half, delta, round(100 * delta / greatest(1, first_half), 4) AS pct,
  round(least(1, abs(delta) / greatest(1, first_half)), 6) AS effect FROM moved
  ORDER BY abs(delta) DESC, label NULLS LAST LIMIT 1"""


@query("top_mover", f"WITH {halves_sql('orders', 'o_orderdate', 'o_orderpriority')} {_TOP_MOVER}")
def top_mover(spark, folder):
    halves = _half_change(load(spark, folder, "orders"), "o_orderdate", "o_orderpriority")
    return _round4(change.top_mover(halves), "pct").withColumn("effect", F.round("effect", 6))


_LEADER = """totals AS (SELECT label, first_half + second_half AS total,
  row_number() OVER (ORDER BY first_half + second_half DESC, coalesce(label, 'None') DESC) AS place FROM moved),
mover AS (SELECT label FROM moved ORDER BY abs(delta) DESC, label NULLS LAST LIMIT 1)
SELECT a.label AS leader, a.total AS leader_total, b.label AS second_label, b.total AS second_total,
  round((a.total - b.total) / b.total * 100, 2) AS lead_pct FROM totals a, totals b, mover
WHERE a.place = 1 AND b.place = 2 AND a.label = mover.label AND a.label <> '' AND b.label <> '' AND b.total > 0"""


@query("leader_gap", f"WITH {ACTIVITY}, {halves_sql('activity', 'ts', 'channel')}, {_LEADER}")
def leader_gap(spark, folder):
    return change.leader_gap(_half_change(activity(spark, folder), "ts", "channel"))


_SIDES = """sides AS (SELECT event_id AS __rowid, ts,
  CASE WHEN ts >= TIMESTAMP '2024-01-18' THEN 'late' ELSE 'early ' || event_type END AS side FROM events)"""


@query("leader_gap_planted", f"WITH {_SIDES}, {halves_sql('sides', 'ts', 'side')}, {_LEADER}")
def leader_gap_planted(spark, folder):
    """The label that only the later half has leads, and moved most."""
    ds = derive(load(spark, folder, "events"), side=F.when(
        F.col("ts") >= F.lit("2024-01-18").cast("timestamp_ntz"), "late").otherwise(F.concat(F.lit("early "), "event_type")))
    return change.leader_gap(_half_change(ds, "ts", "side"))


_LONG = """texts AS (SELECT doc_id AS __rowid, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(doc_id % 50 AS INTEGER) AS seen,
  CASE WHEN length(text) <= 64 THEN text ELSE left(text, 64) || chr(0) || sha256(text) END AS body FROM documents)"""


@query(
    "half_change_texts",
    f"WITH {_LONG}, {halves_sql('texts', 'seen', 'body')} SELECT replace(label, chr(0), ' ') AS label, first_half, second_half, delta FROM moved",
)
def half_change_texts(spark, folder):
    """Whole documents as labels: they are counted by head and digest."""
    ds = derive(load(spark, folder, "documents"), seen=_seen())
    halves = _half_change(ds, "seen", "text")
    return halves.withColumn("label", F.replace("label", F.lit("\0"), F.lit(" ")))


def _seen():
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int")).cast("timestamp_ntz")


@query(
    "half_volume",
    f"""WITH {_mid_sql('events', 'ts')}, v AS (SELECT count(*) FILTER (WHERE epoch(ts) < mid_epoch) AS first_rows,
  count(*) FILTER (WHERE epoch(ts) >= mid_epoch) AS second_rows FROM events, mid)
SELECT first_rows, second_rows, second_rows - first_rows AS delta,
  round(100 * (second_rows - first_rows) / greatest(1, first_rows), 4) AS pct,
  round(least(1, abs(second_rows - first_rows) / greatest(1, first_rows)), 6) AS effect FROM v""",
)
def half_volume(spark, folder):
    ds = load(spark, folder, "events")
    middle = change.time_midpoint(ds, "ts").first().mid_epoch
    return _round4(change.half_volume(ds, "ts", middle), "pct").withColumn("effect", F.round("effect", 6))
