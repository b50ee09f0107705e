"""Sources, filters, sorting, paging, lookup, evidence rows."""

from pyspark.sql import functions as F

from checks.registry import (
    ACTIVITY, EVENT_COLUMNS, GAPPY_EVENTS, ORDER_COLUMNS, activity, derive, gappy_events, iso_sql, load,
    query, with_iso,
)
from veritable import ROW_ID, scratch_path
from veritable.functions.times import iso_text
from veritable.operators import outliers, rows
from veritable.operators.concentration import concentration_flagged
from veritable.operators.rank_index import RankIndex
from veritable.sources.delimited import scan_delimited
from veritable.sources.row_ids import read_with_row_ids
from veritable.sources.sinks import export_view
from veritable.sources.versions import current, refresh

# --- sources and sinks -----------------------------------------------------------------


@query("csv_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_scan(spark, folder):
    path = scratch_path(spark, "csv_scan")
    export_view(load(spark, folder, "documents"), path)
    scanned = scan_delimited(spark, path)
    return scanned.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "n_chars")})


@query("text_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def text_scan(spark, folder):
    path = scratch_path(spark, "text_scan")
    export_view(load(spark, folder, "customer"), path, sep="\t")
    return scan_delimited(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_zoned", f"SELECT event_id, {iso_sql('ts')} AS ts FROM events")
def csv_zoned(spark, folder):
    """Moments written with an offset come back in UTC."""
    path = scratch_path(spark, "csv_zoned")
    events = load(spark, folder, "events").df
    ahead = F.date_format((F.col("ts") + F.expr("interval 5 hours 30 minutes")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events.select("event_id", F.concat(ahead, F.lit("+05:30")).alias("ts")).write.csv(path, header=True)
    back = scan_delimited(spark, path)
    return back.select(F.col("event_id").cast("long"), iso_text(F.col("ts")).alias("ts"))


@query(
    "csv_ragged",
    """SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS column2,
  CASE WHEN c_custkey % 9 = 0 THEN 'a,b ' || c_custkey END AS column3 FROM customer""",
)
def csv_ragged(spark, folder):
    """Cells beyond the header are kept, quoted separators are not taken for cells."""
    path = scratch_path(spark, "csv_ragged")
    more = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(","), "c_mktsegment")).otherwise("")
    most = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit(',"a,b '), "c_custkey", F.lit('"'))).otherwise("")
    line = F.concat("c_custkey", F.lit(","), "c_acctbal", more, most)
    # the first line of each file is its header
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = load(spark, folder, "customer").df.select(F.concat(F.when(first, "c_custkey,c_acctbal\n").otherwise(""), line).alias("value"))
    lines.write.text(path)
    return scan_delimited(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_multiline", "SELECT doc_id, 'first' || chr(10) || '\"' || text || '\",' || chr(10) AS body, n_chars FROM documents")
def csv_multiline(spark, folder):
    """Files whose quoted fields hold line breaks, quotes and separators, cut into records by many tasks."""
    path = scratch_path(spark, "csv_multiline")
    body = F.concat(F.lit('first\n"'), "text", F.lit('",\n'))
    documents = load(spark, folder, "documents").df.select("doc_id", body.alias("body"), "n_chars")
    documents.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreTrailingWhiteSpace=False)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        scanned = scan_delimited(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    return scanned.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "n_chars")})


@query("sample_rows", f"SELECT {EVENT_COLUMNS} FROM events WHERE event_id < 700")
def capped_sample(spark, folder):
    events = load(spark, folder, "events")
    return with_iso(events, rows.sample_rows(events, 700).df)


@query("row_ids", "SELECT event_id AS __rowid, event_id, event_type, value FROM events")
def row_ids(spark, folder):
    path = scratch_path(spark, "row_ids")
    events = load(spark, folder, "events").df.drop(ROW_ID)
    parts = events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    parts.write.parquet(path)
    return read_with_row_ids(spark, path).select(ROW_ID, "event_id", "event_type", "value")


@query(
    "export_view",
    f"SELECT event_id, {iso_sql('ts')} AS ts, user_id, event_type, value, props FROM events "
    "WHERE event_type <> 'error' AND value >= 10",
)
def exported(spark, folder):
    view = load(spark, folder, "events").slice(
        [{"col": "event_type", "op": "neq", "value": "error"}, {"col": "value", "op": "gte", "value": 10}]
    )
    path = scratch_path(spark, "export")
    export_view(view, path, "value", "desc")
    back = scan_delimited(spark, path)
    back = back.withColumns({c: F.col(c).cast("long") for c in ("event_id", "user_id")})
    return with_iso(view, back)


@query("refresh_current", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_custkey AS __rowid FROM customer")
def refresh_current(spark, folder):
    """Two versions of a table: the second replaces the first."""
    root = scratch_path(spark, "refresh")
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    customers = load(spark, folder, "customer").df.orderBy("c_custkey").select(*columns)
    refresh(spark, root, lambda: customers.withColumn("c_name", F.lit("old")))
    refresh(spark, root, lambda: customers)
    return current(spark, root).df.select(*columns, ROW_ID)


# --- filters ---------------------------------------------------------------------------


def _filtered(table, filters, where, columns):
    def run(spark, folder):
        ds = load(spark, folder, table).slice(filters)
        return with_iso(ds)

    return run, f"SELECT {columns} FROM {table} WHERE {where}"


_FILTERS = {
    "filter_conjunction": (
        "events",
        '[{"col": "event_type", "op": "neq", "value": "view"}, {"col": "value", "op": "gte", "value": "20"},'
        ' {"col": "ts", "op": "lte", "value": "2024-01-20"}, {"col": "user_id", "op": "eq", "value": ""},'
        ' {"col": null, "op": "eq", "value": 1}]',
        "event_type <> 'view' AND value >= 20 AND ts <= TIMESTAMP '2024-01-20'",
        EVENT_COLUMNS,
    ),
    "filter_number_eq": (
        "events", [{"col": "user_id", "op": "eq", "value": "42"}], "user_id = 42", EVENT_COLUMNS,
    ),
    "filter_number_neq": (
        "events", [{"col": "user_id", "op": "neq", "value": 0}], "user_id <> 0", EVENT_COLUMNS,
    ),
    "filter_number_range": (
        "orders",
        [{"col": "o_totalprice", "op": "gte", "value": 1000.5},
         {"col": "o_totalprice", "op": "lte", "value": "250000"},
         {"col": "o_custkey", "op": "gte", "value": 10.5}],
        "o_totalprice >= 1000.5 AND o_totalprice <= 250000 AND o_custkey >= 10.5",
        ORDER_COLUMNS,
    ),
    "filter_date_range": (
        "orders",
        [{"col": "o_orderdate", "op": "gte", "value": "1996-03-01"},
         {"col": "o_orderdate", "op": "lte", "value": "1998-06-30T12:00:00"}],
        "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1998-06-30 12:00:00'",
        ORDER_COLUMNS,
    ),
    "filter_text_eq": (
        "events", [{"col": "event_type", "op": "eq", "value": "click"}], "event_type = 'click'",
        EVENT_COLUMNS,
    ),
    "filter_text_neq": (
        "orders", [{"col": "o_orderpriority", "op": "neq", "value": "5-LOW"}],
        "o_orderpriority <> '5-LOW'", ORDER_COLUMNS,
    ),
    "filter_text_contains": (
        "documents", [{"col": "text", "op": "contains", "value": "THE_E"}], "text ILIKE '%THE_E%'",
        "doc_id, text, lang, source, n_chars",
    ),
}

for _name, _spec in _FILTERS.items():
    _run, _sql = _filtered(*_spec)
    query(_name, _sql)(_run)


@query(
    "filter_nulls",
    f"WITH {GAPPY_EVENTS} SELECT {EVENT_COLUMNS} FROM gappy WHERE event_type <> 'view' AND value <= 50",
)
def filter_nulls(spark, folder):
    ds = gappy_events(spark, folder).slice(
        [{"col": "event_type", "op": "neq", "value": "view"}, {"col": "value", "op": "lte", "value": 50}]
    )
    return with_iso(ds)


@query("slice_count", "SELECT count(*) AS row_count FROM events WHERE event_type = 'click' AND value >= 5")
def slice_count(spark, folder):
    ds = load(spark, folder, "events").slice(
        [{"col": "event_type", "op": "eq", "value": "click"}, {"col": "value", "op": "gte", "value": 5}]
    )
    return rows.slice_count(ds)


# --- sorting, paging, lookup -----------------------------------------------------------


@query("sort_asc", f"WITH {GAPPY_EVENTS} SELECT {EVENT_COLUMNS} FROM gappy ORDER BY value ASC NULLS LAST, event_id")
def sort_asc(spark, folder):
    ds = gappy_events(spark, folder)
    return with_iso(ds, rows.sorted_rows(ds, "value", "asc"))


@query("sort_desc", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey")
def sort_desc(spark, folder):
    ds = load(spark, folder, "orders")
    return with_iso(ds, rows.sorted_rows(ds, "o_orderpriority", "desc"))


@query(
    "page_query",
    f"WITH {GAPPY_EVENTS}, slice AS (SELECT * FROM gappy WHERE user_id >= 10) "
    f"SELECT {EVENT_COLUMNS}, event_id AS __rowid, (SELECT count(*) FROM slice) AS total_count "
    "FROM slice ORDER BY value DESC NULLS LAST, event_id LIMIT 100 OFFSET 200",
)
def page_query(spark, folder):
    ds = gappy_events(spark, folder).slice([{"col": "user_id", "op": "gte", "value": 10}])
    page = rows.page(ds, number=3, size=100, sort_by="value", sort_order="desc", total=True)
    return with_iso(ds, page, "total_count").withColumn(ROW_ID, F.col("event_id"))


@query(
    "page_deep",
    f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 1400",
)
def page_deep(spark, folder):
    # a low top-k limit sends this page through the key ranges that far pages take
    ds = load(spark, folder, "orders")
    return with_iso(ds, rows.page(ds, 29, 50, "o_totalprice", "asc", shallow_rows=300))


@query(
    "page_indexed",
    f"""WITH g AS (SELECT event_id, ts, user_id, event_type, CASE WHEN value <= 100 THEN round(value) END AS value, props FROM events)
SELECT * FROM (SELECT 'deep' AS view, {EVENT_COLUMNS} FROM g ORDER BY value DESC NULLS LAST, event_id LIMIT 40 OFFSET 280)
UNION ALL SELECT * FROM (SELECT 'last' AS view, {EVENT_COLUMNS} FROM g ORDER BY value DESC NULLS LAST, event_id LIMIT 40 OFFSET 960)""",
)
def page_indexed(spark, folder):
    """Two pages from one rank index: many equal keys, NULLs last."""
    ds = derive(load(spark, folder, "events"), value=F.round(F.when(F.col("value") <= 100, F.col("value"))))
    index = RankIndex.build(ds, "value", "desc", range_rows=200)
    pages = [with_iso(ds, index.page(n, 40), F.lit(view).alias("view")) for n, view in ((8, "deep"), (25, "last"))]
    return pages[0].unionByName(pages[1])


@query(
    "page_nan",
    "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'NaN' ELSE CAST(CAST(round(value, 2) * 100 AS BIGINT) AS VARCHAR) END AS cents "
    "FROM events ORDER BY event_type = 'error' DESC, CASE WHEN event_type = 'error' THEN 0 ELSE value END DESC, event_id LIMIT 50 OFFSET 700",
)
def page_nan(spark, folder):
    """A deep page of a descending sort: NaN comes first, as the highest value."""
    nan = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    ds = derive(load(spark, folder, "events"), value=nan)
    cents = F.when(F.isnan("value"), "NaN").otherwise((F.round("value", 2) * 100).cast("long").cast("string"))
    return rows.page(ds, 15, 50, "value", "desc", shallow_rows=100).select("event_id", "event_type", cents.alias("cents"))


@query(
    "rows_by_id",
    f"WITH ids AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 7), (4, 120)) v(pos, id)) "
    f"SELECT pos, {EVENT_COLUMNS} FROM ids JOIN events ON event_id = id ORDER BY pos",
)
def rows_by_id(spark, folder):
    ds = load(spark, folder, "events")
    found = rows.rows_by_id(ds, [7, 3, 999_999_999, 7, 120])
    return with_iso(ds, found, "pos")


# --- evidence rows ---------------------------------------------------------------------


@query(
    "missing_rows",
    f"WITH {GAPPY_EVENTS} SELECT event_id AS __rowid FROM gappy "
    "WHERE event_type IS NULL OR event_type = '' ORDER BY event_id LIMIT 25",
)
def missing_rows(spark, folder):
    ds = gappy_events(spark, folder)
    return rows.evidence(ds, ds.column("event_type").blank)


_FENCES = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(
    "outlier_rows",
    f"WITH {_FENCES} SELECT event_id AS __rowid FROM events, f WHERE value < lo OR value > hi "
    "ORDER BY abs(value - (q1 + q3) / 2) DESC, event_id LIMIT 25",
)
def outlier_rows(spark, folder):
    ds = load(spark, folder, "events")
    value = ds.column("value")
    row = outliers.outlier_stats(ds, [value]).first()
    beyond = outliers.outside(value.ref, F.lit(row.lower_fence), F.lit(row.upper_fence))
    return rows.evidence(ds, beyond, F.abs(value.ref - F.lit((row.q1 + row.q3) / 2)).desc())


@query(
    "concentration_rows",
    "SELECT doc_id AS __rowid FROM documents WHERE lang = (SELECT lang FROM documents GROUP BY lang "
    "ORDER BY count(*) DESC, lang LIMIT 1) ORDER BY doc_id LIMIT 25",
)
def concentration_rows(spark, folder):
    ds = load(spark, folder, "documents")
    top = concentration_flagged(ds).first()
    return rows.evidence(ds, ds.column(top.column).label == top.label)


@query(
    "trend_evidence",
    "(SELECT 'low' AS side, event_id AS __rowid FROM events ORDER BY ts, event_id LIMIT 5) UNION ALL "
    "(SELECT 'high' AS side, event_id AS __rowid FROM events ORDER BY ts DESC, event_id LIMIT 5)",
)
def trend_evidence(spark, folder):
    return rows.extremes(load(spark, folder, "events"), "ts", 5)


@query(
    "corr_evidence",
    f"WITH {ACTIVITY} (SELECT 'low' AS side, __rowid FROM activity WHERE value IS NOT NULL AND score IS NOT NULL "
    "ORDER BY value, __rowid LIMIT 4) UNION ALL (SELECT 'high' AS side, __rowid FROM activity "
    "WHERE value IS NOT NULL AND score IS NOT NULL ORDER BY value DESC, __rowid LIMIT 4)",
)
def corr_evidence(spark, folder):
    ds = activity(spark, folder)
    return rows.extremes(ds, "value", 4, ds.column("score").ref.isNotNull())
