"""Profile and data quality."""

from pyspark.sql import functions as F

from checks.registry import GAPPY_EVENTS, derive, gappy_events, iso_sql, load, query
from veritable import ROW_ID, Dataset
from veritable.functions.scores import confidence, trust
from veritable.functions.wording import (
    chart_number, first_sentence, human_number, multiple_phrase, signed_percent,
)
from veritable.operators import profile
from veritable.sources.row_ids import read_with_row_ids

_KIND = (
    "CASE WHEN regexp_matches(column_type, 'INT|DECIMAL|DOUBLE|FLOAT') THEN 'number' "
    "WHEN regexp_matches(column_type, 'TIMESTAMP|DATE') THEN 'date' ELSE 'text' END"
)


@query(
    "schema_classes",
    f"SELECT column_name AS name, {_KIND} AS type, column_type LIKE '%INT%' AS is_integer, "
    "(SELECT count(*) FROM events) AS row_count FROM (DESCRIBE SELECT * FROM events)",
)
def schema_classes(spark, folder):
    classes = profile.schema_classes(load(spark, folder, "events"))
    return classes.select("name", "type", "is_integer", "row_count")


def _summary(table, kind, columns):
    def run(spark, folder):
        ds = gappy_events(spark, folder) if table == "gappy" else load(spark, folder, table)
        return profile.summary(ds).where(F.col("type") == kind).select("name", *columns)

    return run


def _numbers_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS min_number, "
        f"CAST(max({c}) AS DOUBLE) AS max_number, round(avg({c}), 4) AS avg FROM {table}"
        for c in columns
    )


query(
    "summary_numeric",
    f"WITH {GAPPY_EVENTS} " + _numbers_sql("gappy", ["event_id", "user_id", "value"]),
)(_summary("gappy", "number", ["min_number", "max_number", "avg"]))

query(
    "summary_date",
    f"SELECT 'o_orderdate' AS name, {iso_sql('min(o_orderdate)')} AS min_date, "
    f"{iso_sql('max(o_orderdate)')} AS max_date FROM orders",
)(_summary("orders", "date", ["min_date", "max_date"]))

query(
    "summary_text",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) AS distinct_values FROM documents"
        for c in ("text", "lang", "source")
    ),
)(_summary("documents", "text", ["distinct_values"]))


@query(
    "key_numbers",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", round(sum({c}), 2) AS sum, round(avg({c}), 4) AS avg, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM orders"
        for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])
    ),
)
def key_numbers(spark, folder):
    # sums of doubles differ in the last digits with the order of addition
    return profile.key_numbers(load(spark, folder, "orders")).withColumn("sum", F.round("sum", 2))


@query(
    "date_range",
    f"SELECT 'ts' AS \"column\", {iso_sql('min(ts)')} AS min, {iso_sql('max(ts)')} AS max, "
    "CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM events",
)
def date_range(spark, folder):
    return profile.date_range(load(spark, folder, "events"))


def _missing_sql(where=""):
    kinds = {"event_id": "number", "ts": "date", "user_id": "number", "event_type": "text",
             "value": "number", "props": "text"}
    blank = {c: f"{c} IS NULL OR {c} = ''" if k == "text" else f"{c} IS NULL" for c, k in kinds.items()}
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS type, "
        f"count(*) FILTER (WHERE {blank[c]}) AS missing, "
        f"round(count(*) FILTER (WHERE {blank[c]}) / count(*), 4) AS missing_fraction, "
        f"round(100 * (count(*) FILTER (WHERE {blank[c]}) / count(*)), 2) AS missing_pct FROM gappy"
        for i, (c, k) in enumerate(kinds.items())
    )
    return f"WITH {GAPPY_EVENTS} SELECT * FROM ({rows}) {where}"


@query("missing_by_column", _missing_sql())
def missing_by_column(spark, folder):
    return profile.missing_by_column(gappy_events(spark, folder))


@query("missing_flagged", _missing_sql("WHERE missing_fraction >= 0.20"))
def missing_flagged(spark, folder):
    return profile.missing_flagged(gappy_events(spark, folder))


def _texts_only(spark, folder):
    """Documents without their key, so that copies are equal rows."""
    ds = load(spark, folder, "documents")
    return Dataset.of(ds.df.select("text", ROW_ID), name="texts")


@query(
    "duplicate_count",
    "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) "
    "AS duplicate_rows",
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(_texts_only(spark, folder))


@query(
    "duplicate_rows",
    "SELECT doc_id AS __rowid FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn "
    "FROM documents) WHERE rn > 1 ORDER BY doc_id LIMIT 25",
)
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(_texts_only(spark, folder))


@query(
    "data_quality",
    f"""WITH {GAPPY_EVENTS}
SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_columns, 1 AS date_columns, 2 AS text_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gappy)) AS duplicate_rows,
  round((round(count(*) FILTER (WHERE event_type IS NULL) / count(*), 4)
       + round(count(*) FILTER (WHERE value IS NULL) / count(*), 4)) / 6, 6) AS mean_missing,
  count(*) < 30 AS small_sample FROM gappy""",
)
def data_quality(spark, folder):
    return profile.data_quality(gappy_events(spark, folder))


def lineitem(spark, folder):
    return Dataset.of(read_with_row_ids(spark, f"{folder}/lineitem.parquet"), name="lineitem")


@query(
    "monotonic_violations",
    """WITH numbered AS (SELECT l_orderkey, row_number() OVER () AS r FROM lineitem),
steps AS (SELECT l_orderkey AS v, lag(l_orderkey) OVER (ORDER BY r) AS p FROM numbered)
SELECT 'l_orderkey' AS "column", count(*) FILTER (WHERE v <= p) AS violations,
  count(*) AS "values" FROM steps""",
)
def monotonic_violations(spark, folder):
    # small blocks, so that the test data has many block borders
    return profile.monotonic_violations(lineitem(spark, folder), "l_orderkey", block_rows=1_000)


@query(
    "monotonic_with_gaps",
    """WITH numbered AS (SELECT CASE WHEN value <= 100 THEN user_id END AS v, event_id AS r FROM events),
steps AS (SELECT v, lag(v) OVER (ORDER BY r) AS p FROM numbered WHERE v IS NOT NULL)
SELECT 'user_id' AS "column", count(*) FILTER (WHERE v <= p) AS violations,
  count(*) AS "values" FROM steps""",
)
def monotonic_with_gaps(spark, folder):
    ds = load(spark, folder, "events")
    gaps = ds.df.withColumn("user_id", F.when(F.col("value") <= 100, F.col("user_id")))
    return profile.monotonic_violations(Dataset.of(gaps), "user_id", block_rows=37)


@query(
    "identifier_columns",
    """WITH d AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, count(DISTINCT o_custkey) AS c FROM orders)
SELECT 'o_orderkey' AS "column", 'unique' AS reason FROM d WHERE k >= 0.95 * n
UNION ALL SELECT 'o_custkey', 'unique' FROM d WHERE c >= 0.95 * n""",
)
def identifier_columns(spark, folder):
    return profile.identifier_columns(load(spark, folder, "orders"))


@query(
    "identifier_reasons",
    """WITH steps AS (SELECT CASE WHEN value <= 100 THEN event_id * 3 END AS s FROM events),
d AS (SELECT count(*) AS n, count(s) AS filled, count(DISTINCT s) AS k FROM steps)
SELECT 'batch_key' AS "column", 'name' AS reason UNION ALL SELECT 'user_id', 'name' UNION ALL SELECT 'event_id', 'name'
UNION ALL SELECT 'steps', CASE WHEN k >= 0.95 * n THEN 'unique' ELSE 'increasing' END FROM d WHERE k = filled AND filled >= 2""",
)
def identifier_reasons(spark, folder):
    """Columns named like an identifier, and one that grows with the row id."""
    ds = derive(
        load(spark, folder, "events"), steps=F.when(F.col("value") <= 100, F.col("event_id") * 3),
        batch_key=F.floor(F.col("value")), level=F.floor(F.col("value") * 2),
    )
    return profile.identifier_columns(ds)


@query(
    "duplicate_lines",
    """SELECT count(*) - count(DISTINCT (l_orderkey % 10, l_partkey % 7, l_quantity, l_returnflag)) AS duplicate_rows FROM lineitem""",
)
def duplicate_lines(spark, folder):
    """Duplicates among derived columns of the order lines, by one digest a row."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.monotonically_increasing_id().alias(ROW_ID), (F.col("l_orderkey") % 10).alias("a"), (F.col("l_partkey") % 7).alias("b"), "l_quantity", "l_returnflag")
    return profile.duplicate_count(Dataset.of(lines))


# --- scores and wording ----------------------------------------------------------------


@query(
    "score_formulas",
    """WITH g AS (SELECT o_custkey, count(*) AS n,
  count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*) AS effect,
  count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS missing,
  1.2 - count(*) FILTER (WHERE o_totalprice > 250000) / count(*) AS consistency
  FROM orders GROUP BY o_custkey)
SELECT o_custkey, n,
  round(greatest(0.0, least(1.0, least(1.0, n / 50.0) * greatest(0.0, least(1.0, effect)))), 3) AS confidence,
  CAST(round_even(100 * least(1.0, n / 50.0) * greatest(0.0, 1.0 - greatest(0.0, missing))
    * greatest(0.0, least(1.0, consistency)), 0) AS INTEGER) AS trust_score FROM g""",
)
def score_formulas(spark, folder):
    def share(condition):
        return F.count_if(condition) / F.count("*")

    ds = load(spark, folder, "orders")
    groups = ds.df.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        share(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("effect"),
        share(F.col("o_orderstatus") == "F").alias("missing"),
        (1.2 - share(F.col("o_totalprice") > 250000)).alias("consistency"),
    )
    return groups.select(
        "o_custkey", "n",
        confidence(F.col("n"), F.col("effect")).alias("confidence"),
        trust(F.col("n"), F.col("missing"), F.col("consistency")).alias("trust_score"),
    )


_TRIM = "regexp_replace({}, '\\.?0+$', '')"


def _plain_sql(v, digits):
    return _TRIM.format(f"format('{{:,.{digits}f}}', {v})")


@query(
    "format_numbers",
    f"""WITH v AS (SELECT event_id, value / 100 AS small, value AS middle, value * 1000 AS large FROM events)
SELECT event_id,
  CASE WHEN small = floor(small) THEN format('{{:,.0f}}', small) WHEN small >= 1 THEN {_plain_sql('small', 2)}
       ELSE {_plain_sql('small', 4)} END AS small,
  CASE WHEN middle = floor(middle) OR middle >= 100 THEN format('{{:,.0f}}', round_even(middle, 0))
       WHEN middle >= 1 THEN {_plain_sql('middle', 2)} ELSE {_plain_sql('middle', 4)} END AS middle,
  CASE WHEN large = floor(large) THEN format('{{:,.0f}}', large) ELSE {_plain_sql('large', 2)} END AS large,
  CASE WHEN 1 + middle / 100 < round_even(2 * (1 + middle / 100), 0) / 2 THEN 'almost ' ELSE 'about ' END
    || regexp_replace(format('{{:.1f}}', round_even(2 * (1 + middle / 100), 0) / 2), '\\.0$', '') || '×' AS multiple,
  CASE WHEN middle > 200 THEN NULL ELSE '+' || format('{{:.0f}}', round_even(middle, 0)) || '%' END AS percent
FROM v""",
)
def format_numbers(spark, folder):
    value = F.col("value")
    return load(spark, folder, "events").df.select(
        "event_id",
        human_number(value / 100).alias("small"),
        human_number(value).alias("middle"),
        chart_number(value * 1000).alias("large"),
        multiple_phrase(value).alias("multiple"),
        F.when(value <= 200, signed_percent(value)).alias("percent"),
    )


@query(
    "digest_text",
    r"""WITH t AS (SELECT doc_id,
  trim(regexp_replace(text || ' (closing remark 1.5)', '\s*\([^()]*\)\s*$', '')) AS body FROM documents)
SELECT doc_id, trim(CASE WHEN regexp_matches(body, '[.!?]\s')
  THEN regexp_extract(body, '^(.*?[.!?])\s', 1, 's') ELSE body END) AS digest FROM t""",
)
def digest_text(spark, folder):
    ds = load(spark, folder, "documents")
    body = F.concat("text", F.lit(" (closing remark 1.5)"))
    return ds.df.select("doc_id", first_sentence(body).alias("digest"))
