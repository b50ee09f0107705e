"""Dense, stable row ids for Parquet tables of any number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.schema import ROW_ID

# One offset row is two longs. Up to this many files they are broadcast (16 MB).
BROADCAST_FILES = 1_000_000


def _file_order() -> list[Column]:
    """Files by folder and part number, as a writer numbered them; then by name."""
    folder = F.regexp_extract("__file", r"^(.*)/[^/]*$", 1)
    number = F.try_to_number(F.nullif(F.regexp_extract("__file", r"/part-(\d{1,18})[^/]*$", 1), F.lit("")), F.lit("9" * 18))
    return [folder, number.asc_nulls_last(), F.col("__file")]


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(hash of a file's path, rows of all files before it), one row per file with rows.

    Counting reads file footers only. The window runs over one row per file.
    """
    per_file = (
        spark.read.parquet(path).select(F.col("_metadata.file_path").alias("__file"))
        .groupBy("__file").agg(F.count("*").alias("__rows"))
    )
    earlier = Window.orderBy(*_file_order()).rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select(
        F.xxhash64("__file").alias("__key"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
    )


def read_with_row_ids(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """A Parquet table with ids 0..n-1, ordered by part number and position in the file.

    The ids depend on the files only, not on how the scan is split, so they are the same
    on every read. The position in the file comes from the Parquet reader; ``offsets`` are
    the stored `file_offsets`, which are counted here where they are not given.
    """
    table = spark.read.parquet(path)
    if ROW_ID in table.columns:
        return table
    offsets = file_offsets(spark, path) if offsets is None else offsets
    files, keys = offsets.agg(F.count("*"), F.count_distinct("__key")).first()
    if files != keys:
        raise ValueError("two file paths have the same hash; move one of the files")
    located = table.select(
        "*", F.xxhash64("_metadata.file_path").alias("__key"), F.col("_metadata.row_index").alias("__index")
    )
    joined = located.join(F.broadcast(offsets) if files <= BROADCAST_FILES else offsets, "__key")
    return joined.withColumn(ROW_ID, F.col("__offset") + F.col("__index")).drop("__key", "__index", "__offset")


def write_with_row_ids(df: DataFrame, path: str) -> DataFrame:
    """Store a table from any source and read it back with row ids.

    The rows are written once, under ``<path>/raw``; the ids follow from the files and the small
    table of offsets under ``<path>/offsets``.
    """
    spark = df.sparkSession
    df.write.parquet(f"{path}/raw")
    file_offsets(spark, f"{path}/raw").write.parquet(f"{path}/offsets")
    return read_stored(spark, path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """What `write_with_row_ids` stored."""
    return read_with_row_ids(spark, f"{path}/raw", spark.read.parquet(f"{path}/offsets"))
