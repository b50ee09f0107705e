"""Where queries register, and the tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable import ROW_ID, Dataset
from veritable.functions.times import iso_text
from veritable.schema import DATE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Natural keys that number the rows of a test table from 0 in file order.
ROW_KEYS = {"events": "event_id", "orders": "o_orderkey", "documents": "doc_id", "customer": "c_custkey"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same result where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, folder: str, table: str) -> Dataset:
    """A test table as a dataset."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return Dataset.of(df, ROW_KEYS[table], table)


def derive(ds: Dataset, **columns: Column) -> Dataset:
    """The dataset with columns replaced or added."""
    df = ds.df.withColumns(columns)
    return Dataset.of(df, name=ds.name)


def gappy_events(spark: SparkSession, folder: str) -> Dataset:
    """Events with blanks: no type for errors, no value above 100."""
    return derive(
        load(spark, folder, "events"),
        event_type=F.nullif("event_type", F.lit("error")),
        value=F.when(F.col("value") <= 100, F.col("value")),
    )


GAPPY_EVENTS = """gappy AS (
  SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
         CASE WHEN value <= 100 THEN value END AS value, props
  FROM events)"""


def activity(spark: SparkSession, folder: str) -> Dataset:
    """Events with planted patterns: a midweek peak, a perfect pair, a leading label."""
    ds = load(spark, folder, "events")
    midweek = (F.date_trunc("week", "ts") + F.expr("interval 2 days")).cast("timestamp_ntz")
    df = ds.df.select(
        ROW_ID,
        F.when(F.col("event_type") == "purchase", midweek).otherwise(F.col("ts")).alias("ts"),
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("user_id") < 100, "web").otherwise("app").alias("channel"),
        F.lit("ok").alias("status"),
        "value",
        (F.col("value") * 2).alias("score"),
    )
    return Dataset.of(df, name="activity")


ACTIVITY = """activity AS (
  SELECT event_id AS __rowid,
         CASE WHEN event_type = 'purchase'
              THEN CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 2 DAY ELSE ts END AS ts,
         nullif(event_type, 'error') AS kind,
         CASE WHEN user_id < 100 THEN 'web' ELSE 'app' END AS channel,
         'ok' AS status, value, value * 2 AS score
  FROM events)"""


def with_iso(ds: Dataset, df: DataFrame | None = None, *extra: str) -> DataFrame:
    """Rows as they are shown: moments as ISO text, no row id."""
    rows = ds.df if df is None else df
    return rows.select(*extra, *[
        iso_text(c.ref).alias(c.name) if c.kind == DATE else c.ref for c in ds.columns
    ])


def iso_bucket(df: DataFrame, column: str = "bucket") -> DataFrame:
    return df.withColumn(column, iso_text(F.col(column)))


def iso_sql(expr: str) -> str:
    """ISO text of a moment in DuckDB."""
    return (
        f"strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({expr}) % 1000000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST(microsecond({expr}) % 1000000 AS VARCHAR), 6, '0') END"
    )


EVENT_COLUMNS = f"event_id, {iso_sql('ts')} AS ts, user_id, event_type, value, props"
ORDER_COLUMNS = (
    f"o_orderkey, o_custkey, o_orderstatus, o_totalprice, {iso_sql('o_orderdate')} AS o_orderdate, "
    "o_orderpriority"
)
