"""A DataFrame with a stable row id and classed columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.predicates import filter_predicate
from veritable.schema import DATE, NUMBER, ROW_ID, TEXT, ColumnInfo, describe, ref


@dataclass(frozen=True)
class Dataset:
    """The rows under study. ``df`` always carries the row id column."""

    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    name: str = "dataset"

    @classmethod
    def of(cls, df: DataFrame, row_id: str | None = None, name: str = "dataset") -> Dataset:
        """Wrap ``df``.

        ``row_id`` names a dense 0-based key column to take as the row id; without
        it ``df`` must hold the row id column written at ingest.
        """
        if row_id is not None:
            df = df.withColumn(ROW_ID, ref(row_id).cast("long"))
        elif ROW_ID not in df.columns:
            raise ValueError(f"the table has no {ROW_ID} column; ingest it or pass row_id")
        return cls(df, describe(df.schema), name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def numbers(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.kind == NUMBER]

    @property
    def dates(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.kind == DATE]

    @property
    def texts(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.kind == TEXT]

    def column(self, name: str, kind: str | None = None) -> ColumnInfo:
        for info in self.columns:
            if info.name == name:
                if kind and info.kind != kind:
                    raise ValueError(f"{name!r} is a {info.kind} column, not a {kind} column")
                return info
        raise ValueError(f"unknown column {name!r}")

    def where(self, predicate: Column) -> Dataset:
        return replace(self, df=self.df.where(predicate))

    def slice(self, filters: str | list[dict] | None) -> Dataset:
        """Rows that satisfy every item of a filter list (see ``filter_predicate``)."""
        predicate = filter_predicate(self.columns, filters)
        return self if predicate is None else self.where(predicate)

    def values(self) -> DataFrame:
        """The data columns without the row id."""
        return self.df.select(*[c.ref for c in self.columns])

    def count_rows(self) -> int:
        return self.df.agg(F.count("*").alias("n")).first().n
