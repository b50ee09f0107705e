"""Full-replace refresh: a new version becomes current only once it is complete."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.sources.delimited import validate
from veritable.sources.row_ids import read_stored, write_with_row_ids

_LOG_SCHEMA = "version long, path string, row_count long, started_at timestamp, refreshed_at timestamp"


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG_SCHEMA).parquet(f"{root}/versions")
    except AnalysisException:
        return spark.createDataFrame([], _LOG_SCHEMA)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def take_number(spark: SparkSession, root: str) -> int:
    """A version number that no other writer has: the one whose marker file this call created.

    A file that must not exist yet is created for each number; of several writers who try one
    number at once the file system lets a single one through, and the others try the next.
    """
    number = _log(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    while True:
        files, marker = _files(spark, f"{root}/numbers/{number:012d}")
        try:
            files.create(marker, False).close()
            return number
        except Py4JJavaError as exc:
            if not files.exists(marker):
                raise RuntimeError(f"no version number can be taken below {root}") from exc
            number += 1


def current(spark: SparkSession, root: str, name: str = "dataset") -> Dataset:
    """The complete version whose load began last.

    Of two loads at once the order of their starts decides, not that of their numbers, so that
    an older load never hides a newer one.
    """
    latest = _log(spark, root).orderBy(F.desc("started_at"), F.desc("refreshed_at"), "path").first()
    if latest is None:
        raise ValueError(f"{root} holds no data yet")
    return Dataset.of(read_stored(spark, latest.path), name=name)


def refresh(
    spark: SparkSession, root: str, load: Callable[[], DataFrame], name: str = "dataset"
) -> Dataset:
    """Load, check and store a new version, then make it current.

    Readers find versions through the log, which is appended to last. When loading or
    checking fails, the log and with it the current version stay as they are. Replaced versions
    stay until ``expire``: a reader may still be on them.
    """
    started = spark.range(1).select(F.current_timestamp()).first()[0]
    table = validate(load())
    path = f"{root}/data/{uuid.uuid4().hex}"
    stored = write_with_row_ids(table, path)
    rows = stored.count()
    entry = spark.range(1).select(
        F.lit(take_number(spark, root)).cast("long").alias("version"), F.lit(path).alias("path"),
        F.lit(rows).cast("long").alias("row_count"), F.lit(started).alias("started_at"), F.current_timestamp().alias("refreshed_at"),
    )
    entry.write.mode("append").parquet(f"{root}/versions")
    return Dataset.of(stored, name=name)


def expire(spark: SparkSession, root: str, older_than: timedelta) -> list[int]:
    """Remove the rows of replaced versions that were complete longer ago than that; their numbers.

    The current version stays whatever its age, and so does the log.
    """
    log = _log(spark, root)
    kept = log.orderBy(F.desc("started_at"), F.desc("refreshed_at"), "path").limit(1).select("path")
    age = F.unix_micros(F.current_timestamp()) - F.unix_micros("refreshed_at")
    limit = older_than // timedelta(microseconds=1)
    removed = []
    for row in log.join(kept, "path", "left_anti").where(age > limit).orderBy("version").toLocalIterator():
        files, folder = _files(spark, row.path)
        if files.exists(folder):
            files.delete(folder, True)
            removed.append(row.version)
    return removed
