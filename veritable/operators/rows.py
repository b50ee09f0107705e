"""Row views: sorting, paging, lookup by row id, evidence rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.dataset import Dataset
from veritable.functions.times import epoch_micros
from veritable.operators.selection import order_statistics
from veritable.schema import DATE, NUMBER, ROW_ID, TEXT
from veritable.session import small_table

MAX_PAGE_SIZE = 1_000
MAX_LOOKUP = 200
EVIDENCE_ROWS = 25
SAMPLE_ROWS = 50_000

# Row ids looked at before the whole table is, and the longest IN list that Spark hands
# to the Parquet reader value by value.
PREFIX_IDS = 1_000_000
IN_LIST = 10

# A page that ends below this row is a top-k; deeper pages seek to their range first.
SHALLOW_ROWS = 100_000


def ordering(ds: Dataset, sort_by: str | None = None, sort_order: str = "asc") -> list[Column]:
    """Sort keys: NULLs last in both directions, ties by row id."""
    direction = sort_order.lower()
    if direction not in ("asc", "desc"):
        raise ValueError("sort_order must be 'asc' or 'desc'")
    keys = [F.col(ROW_ID).asc()]
    if sort_by:
        key = ds.column(sort_by).group_key
        keys.insert(0, key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last())
    return keys


def sorted_rows(ds: Dataset, sort_by: str | None = None, sort_order: str = "asc") -> DataFrame:
    return ds.df.orderBy(*ordering(ds, sort_by, sort_order))


def sample_rows(ds: Dataset, count: int = SAMPLE_ROWS) -> Dataset:
    """The first rows of a table. A range of row ids, so the scan reads no more than it must."""
    return ds.where(F.col(ROW_ID) < count)


def slice_count(ds: Dataset) -> DataFrame:
    return ds.df.agg(F.count("*").alias("row_count"))


def checked_page(number: int, size: int) -> int:
    """The rows before a page."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"number must be at least 1 and size between 1 and {MAX_PAGE_SIZE}")
    return (number - 1) * size


def page(
    ds: Dataset,
    number: int = 1,
    size: int = 50,
    sort_by: str | None = None,
    sort_order: str = "asc",
    shallow_rows: int = SHALLOW_ROWS,
    total: bool = False,
) -> DataFrame:
    """One page of the sorted view, in order; with ``total``, the rows of the view in a column ``total_count``.

    The ids of the page are found first, reading the sort key only; the other columns
    are then read for these ids.
    """
    skip = checked_page(number, size)
    narrow = ds if sort_by else _id_prefix(ds, skip + size)
    if skip + size > shallow_rows and _can_seek(ds, sort_by):
        narrow, skip = _seek(narrow, skip, sort_by, sort_order, shallow_rows), 0
    view = narrow.df.orderBy(*ordering(narrow, sort_by, sort_order)).offset(skip).limit(size)
    ids = [row[0] for row in view.select(ROW_ID).collect()]
    shown = in_order(ds, ids).drop("pos")
    return shown.withColumn("total_count", F.lit(ds.count_rows())) if total else shown


def _id_prefix(ds: Dataset, need: int, prefix_ids: int = PREFIX_IDS) -> Dataset:
    """The first row ids of a slice, if they hold the rows that are needed."""
    head = ds.where(F.col(ROW_ID) < max(prefix_ids, 2 * need))
    return head if head.count_rows() >= need else ds


def _can_seek(ds: Dataset, sort_by: str | None) -> bool:
    """Nested values have no literal to compare with; they are sorted by Spark alone."""
    if not sort_by or ds.column(sort_by).kind != TEXT:
        return True
    return isinstance(ds.column(sort_by).dtype, (T.StringType, T.BooleanType))


def _seek(ds: Dataset, skip: int, sort_by: str | None, sort_order: str, limit: int) -> Dataset:
    """The rows of a sorted view from place ``skip`` on.

    A deep page as a top-k would keep all rows before it in memory. Here the sort key and
    the row id at the place are found by exact selection, and the page starts there.
    """
    row_id = F.col(ROW_ID)
    at_start, later, place, rows = F.lit(True), F.lit(False), skip, None
    if sort_by:
        info = ds.column(sort_by)
        key = {NUMBER: info.ref, DATE: epoch_micros(info.ref), TEXT: info.label}[info.kind]
        down = sort_order.lower() == "desc"
        nan = F.count_if(F.isnan(key)) if info.is_float else F.lit(0)
        known, nans = ds.df.agg(F.count(key), nan).first()
        if skip >= known:  # the place lies among the NULLs, which come last
            at_start, place = key.isNull(), skip - known
        else:
            rank = known - 1 - skip if down else skip
            [[value]] = order_statistics(ds.df, [(key, known, [rank])], limit, [nans])
            first = F.lit(value)
            at_start = key == first
            before, after = (key > first, key < first) if down else (key < first, key > first)
            later = after | key.isNull()
            earlier, rows = ds.df.agg(F.count_if(before), F.count_if(at_start)).first()
            place = skip - earlier
    ties = ds.where(at_start)
    if rows is None:
        rows = ties.count_rows()
    if place >= rows:
        return ds.where(F.lit(False))
    [[start]] = order_statistics(ties.df, [(row_id, rows, [place])], limit)
    return ds.where(later | (at_start & (row_id >= F.lit(start))))


def with_ids(ids: list[int]) -> Column:
    """Row id predicate in short IN lists, which the Parquet reader checks per row group."""
    distinct = sorted(set(ids))
    parts = [
        F.col(ROW_ID).isin(distinct[i : i + IN_LIST]) for i in range(0, len(distinct), IN_LIST)
    ] or [F.lit(False)]
    while len(parts) > 1:  # pairwise, so that the expression stays flat
        parts = [reduce(or_, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _fetch(ds: Dataset, ids: list[int]) -> DataFrame:
    """Rows of an id list with their place in it."""
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField(ROW_ID, T.LongType())])
    lookup = small_table(ds.df.sparkSession, list(enumerate(ids)), schema)
    # the broadcast holds one page or one lookup, at most 1,000 ids
    return ds.df.where(with_ids(ids)).join(F.broadcast(lookup), ROW_ID)


def in_order(ds: Dataset, ids: list[int]) -> DataFrame:
    """Rows of an id list in its order. Their number is known, so no sort of unknown size is planned."""
    return _fetch(ds, ids).orderBy("pos").limit(max(len(ids), 1))


def rows_by_id(ds: Dataset, ids: list[int] | str, most: int = MAX_LOOKUP) -> DataFrame:
    """Rows in the order asked for; repeats are kept, unknown ids are left out.

    ``ids`` may be text with commas between the ids. A lookup of more than ``most`` ids is refused.
    """
    if isinstance(ids, str):
        ids = [int(part) for part in ids.split(",") if part.strip()]
    if len(ids) > most:
        raise ValueError(f"{len(ids)} row ids are asked for; a lookup takes {most} at most")
    return in_order(ds, [int(i) for i in ids])


def evidence(
    ds: Dataset, predicate: Column | None = None, order: Column | None = None,
    limit: int = EVIDENCE_ROWS,
) -> DataFrame:
    """The first row ids of the slice that satisfy a predicate."""
    rows = ds.df if predicate is None else ds.df.where(predicate)
    keys = [F.col(ROW_ID).asc()] if order is None else [order, F.col(ROW_ID).asc()]
    return rows.orderBy(*keys).limit(limit).select(ROW_ID)


def evidence_list(
    ds: Dataset, predicate: Column | None = None, order: Column | None = None,
    limit: int = EVIDENCE_ROWS, rows: int = 0,
) -> list[int]:
    """``evidence`` as a list.

    The lowest ids of a large table (``rows`` tells its size) are looked for in a prefix
    of the ids first; only rare matches need the whole scan.
    """
    if order is None and rows > PREFIX_IDS:
        head = ds.where(F.col(ROW_ID) < PREFIX_IDS)
        ids = [row[0] for row in evidence(head, predicate, None, limit).collect()]
        if len(ids) == limit:
            return ids
    return [row[0] for row in evidence(ds, predicate, order, limit).collect()]


def evidence_lists(
    ds: Dataset, wanted: list[tuple[Column | None, int]], rows: int, block_ids: int = PREFIX_IDS
) -> list[list[int]]:
    """The first row ids that satisfy each of many predicates, ``(predicate, how many)``, for all of them at once.

    One scan counts the matches of every predicate in blocks of row ids, which tells for each
    predicate the block that its last wanted row lies in; another ranks the matches up to there.
    A table of one block (``rows`` tells its size) needs the second scan only.
    """
    if not wanted:
        return []
    holds = [F.lit(True) if predicate is None else predicate for predicate, _ in wanted]
    bounds: list[int | None] = [None] * len(wanted)
    if rows > block_ids:
        block = F.floor(F.col(ROW_ID) / F.lit(block_ids))
        counts = ds.df.groupBy(block.alias("block")).agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(holds)])
        so_far = Window.orderBy("block")  # one row per block
        reached = counts.select("block", *[(F.sum(f"n{i}").over(so_far) >= count).alias(f"r{i}") for i, (_, count) in enumerate(wanted)])
        last = reached.agg(*[F.min(F.when(F.col(f"r{i}"), F.col("block"))).alias(f"b{i}") for i in range(len(wanted))]).first()
        bounds = [None if b is None else (b + 1) * block_ids for b in last]
    kept = [p if b is None else p & (F.col(ROW_ID) < b) for p, b in zip(holds, bounds)]
    hits = [F.when(p, F.lit(i)) for i, p in enumerate(kept)]
    found = ds.df.where(reduce(or_, kept)).select(F.explode(F.array_compact(F.array(*hits))).alias("i"), ROW_ID)
    place = F.row_number().over(Window.partitionBy("i").orderBy(ROW_ID))
    limit = F.element_at(F.array(*[F.lit(count) for _, count in wanted]), F.col("i") + 1)
    ranked = found.withColumn("place", place).where(F.col("place") <= max(count for _, count in wanted)).where(F.col("place") <= limit)
    lists: list[list[int]] = [[] for _ in wanted]
    for row in sorted(ranked.collect(), key=lambda r: r.place):
        lists[row.i].append(row[ROW_ID])
    return lists


def extremes(
    ds: Dataset, column: str, count: int, predicate: Column | None = None,
    within: dict[str, Column] | None = None,
) -> DataFrame:
    """Row ids with the lowest, then the highest values of a column.

    ``within`` may bound the rows of an end ("low", "high") where it is known that they
    hold enough, so that the scan can skip the others.
    """
    key = ds.column(column).ref
    present = key.isNotNull() if predicate is None else predicate & key.isNotNull()
    parts = []
    for side, order in (("low", key.asc()), ("high", key.desc())):
        kept = present & within[side] if within else present
        parts.append(evidence(ds, kept, order, count).select(F.lit(side).alias("side"), ROW_ID))
    return reduce(DataFrame.unionByName, parts)
