"""A stored index of the places of a sorted view, for many pages of the same view.

The sort key and the row id of every row are dealt over ranges once; what is stored for a
range is its number of rows, the rows before it, and its first key and id. A page looks up the one
or two ranges that hold its places and sorts those only, so the hundredth deep page costs
as little as the first. Rows with equal keys are split by their ids; no key is too common for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.dataset import Dataset
from veritable.operators.rows import checked_page, in_order, ordering
from veritable.schema import ROW_ID
from veritable.session import scratch_path

# Rows of a range; a page sorts the ranges it touches.
RANGE_ROWS = 50_000
#: Ranges at most; beyond, ranges grow, so that the ranges' sample stays small.
MOST_RANGES = 20_000


@dataclass(frozen=True)
class RankIndex:
    """Where each range of a sorted view begins: part, rows, before, at (key, id), and the next range's."""

    ds: Dataset
    sort_by: str
    sort_order: str
    ranges: DataFrame
    path: str
    rows: int

    @classmethod
    def build(
        cls, ds: Dataset, sort_by: str, sort_order: str = "asc", path: str | None = None, range_rows: int = RANGE_ROWS
    ) -> RankIndex:
        """Deal the sorted view over ranges and store where they begin, at ``path`` or in the scratch folder."""
        if isinstance(ds.column(sort_by).dtype, (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"{sort_by!r} holds nested values, which a range cannot begin with")
        spark = ds.df.sparkSession
        path = path or scratch_path(spark, "rank-index")
        rows = ds.count_rows()
        ranges = min(max(1, -(-rows // range_rows)), MOST_RANGES)
        keys = ds.df.select(ds.column(sort_by).group_key.alias("key"), ROW_ID)
        order = _order(sort_order)
        dealt = keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
        # the first row of a part, in the order of the view
        key, row_id = F.col("key"), F.col(ROW_ID)
        up = sort_order.lower() == "asc"
        first, place = (F.min_by, F.struct(key.isNull(), key, row_id)) if up else (F.max_by, F.struct(key.isNotNull(), key, -row_id))
        found = dealt.groupBy("part").agg(F.count("*").alias("rows"), first(F.struct("key", F.col(ROW_ID).alias("id")), place).alias("at"))
        along = Window.orderBy("part")  # one row per range
        before = F.sum("rows").over(along) - F.col("rows")
        found.select("part", "rows", before.alias("before"), "at", F.lead("at").over(along).alias("next")).write.parquet(path)
        return cls(ds, sort_by, sort_order.lower(), spark.read.parquet(path), path, rows)

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """One page of the view, in order; empty beyond the last row."""
        skip = checked_page(number, size)
        touched = self.ranges.filter((F.col("before") < skip + size) & (F.col("before") + F.col("rows") > skip))
        found = sorted(touched.collect(), key=lambda r: r.before)
        if not found:
            return in_order(self.ds, []).drop("pos")
        until = found[-1].next
        kept = self._from(found[0].at) & (~self._from(until) if until else F.lit(True))
        narrow = self.ds.where(kept)
        view = narrow.df.orderBy(*ordering(narrow, self.sort_by, self.sort_order)).offset(skip - found[0].before).limit(size)
        ids = [row[0] for row in view.select(ROW_ID).collect()]
        return in_order(self.ds, ids).drop("pos")

    def _from(self, start) -> Column:
        """Rows of the view from the first row of a range on."""
        key, row_id = self.ds.column(self.sort_by).group_key, F.col(ROW_ID)
        if start.key is None:
            return key.isNull() & (row_id >= start.id)
        first = F.lit(start.key)
        later = key > first if self.sort_order == "asc" else key < first
        return F.coalesce(later | ((key == first) & (row_id >= start.id)), F.lit(True))


def _order(sort_order: str) -> list[Column]:
    if sort_order.lower() == "asc":
        return [F.asc_nulls_last("key"), F.asc(ROW_ID)]
    return [F.desc_nulls_last("key"), F.asc(ROW_ID)]
