"""Labels of text columns in a form of bounded length, and back.

Grouping by whole texts would shuffle whole texts. Up to HEAD_CHARS characters a label stands for
itself; a longer one is grouped as its first HEAD_CHARS characters, a NUL and its SHA-256 digest,
which sorts like the text as far as that head goes. The few labels that a result shows are
spelled out again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.dataset import Dataset
from veritable.schema import ROW_ID, ColumnInfo
from veritable.session import small_table

HEAD_CHARS = 64
MARK = "\0"


def short_label(info: ColumnInfo) -> Column:
    """The label, or the head and digest that stand for a long one."""
    digest = F.concat(F.left(info.label, F.lit(HEAD_CHARS)), F.lit(MARK), F.sha2(info.label, 256))
    return F.when(F.length(info.label) <= HEAD_CHARS, info.label).otherwise(digest)


def spelled(
    ds: Dataset, info: ColumnInfo, df: DataFrame, *columns: str, where: tuple[str, str] | None = None
) -> DataFrame:
    """A result of bounded size with its long labels written out; it is fetched here.

    ``where`` names a column and the value it must have for a row to be touched.
    """
    rows = [list(row) for row in df.collect()]
    places = [df.columns.index(name) for name in columns]
    touched = [row for row in rows if where is None or row[df.columns.index(where[0])] == where[1]]
    long = {row[k] for row in touched for k in places if row[k] is not None and MARK in row[k][HEAD_CHARS : HEAD_CHARS + 1]}
    if long:
        key = short_label(info)
        first = ds.df.where(key.isin(*long)).groupBy(key.alias("k")).agg(F.min(ROW_ID).alias("r"))
        ids = {row.r: row.k for row in first.collect()}
        full = ds.df.where(F.col(ROW_ID).isin(*ids)).select(ROW_ID, info.label.alias("v"))
        texts = {ids[row[0]]: row.v for row in full.collect()}
        for row in touched:
            for k in places:
                row[k] = texts.get(row[k], row[k])
    return small_table(df.sparkSession, rows, df.schema)
