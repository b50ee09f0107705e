"""Records of delimited text whose quoted fields hold line breaks, read by many tasks.

Whether a line break ends a record depends on the quotes before it in the file. Each split counts
its quotes, a running sum over the splits of a file tells which of them begin inside a quoted
field, and then every split cuts its own lines into records. Neighbouring splits form groups; the
pieces of a record that goes on in other splits go to the group where it begins, and one task a
group puts them together. What comes to the driver are 26 bytes for each split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.session import scratch_path

# Control characters that text files do not use, to end records with.
ENDINGS = "\x1e\x1d\x1c\x1f\x02\x03"
_WHOLE, _BEGINS, _GOES_ON, _ENDS = range(4)
# Bytes of text that one task stores.
GROUP_BYTES = 32 << 20


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order within each split of a file, which is named by a hash."""
    text = spark.read.option("lineSep", "\n").text(path)
    where = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return text.select("value", where[0].alias("file"), where[1].alias("start"), F.xxhash64(*where).alias("split"))


@dataclass(frozen=True)
class _Splits:
    """All splits by hash: whether they begin inside a field and whether they begin a file, their place and
    group, and the group where the record begins that they begin inside of."""

    marks: np.ndarray
    inside: np.ndarray
    first: np.ndarray
    place: np.ndarray
    group: np.ndarray
    begun: np.ndarray


def _splits(lines: DataFrame, parallel: int) -> tuple[_Splits, int, str | None]:
    """The splits, the number of groups, and a character that the text does not use."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    used = [F.bool_or(F.contains("value", F.lit(c))).alias(f"u{i}") for i, c in enumerate(ENDINGS)]
    counted = lines.groupBy("split", "file", "start").agg(
        (F.sum(quotes) % 2).alias("odd"), F.bool_or(quotes % 2 == 1).alias("turns"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), *used)
    order = Window.partitionBy("file").orderBy("start")
    inside = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    placed = counted.select(
        "split", inside.alias("inside"), (F.col("start") == 0).alias("first"), (F.col("odd") == 1).alias("odd"), "turns", "bytes",
        F.row_number().over(Window.orderBy("file", "start")).cast("long").alias("place"),  # one row per split
        *[f"u{i}" for i in range(len(ENDINGS))],
    )
    table = placed.toArrow().sort_by("place")
    free = [c for i, c in enumerate(ENDINGS) if not pc.any(table.column(f"u{i}")).as_py()]
    marks, inside, first, odd, turns, size = (
        table.column(n).to_numpy() for n in ("split", "inside", "first", "odd", "turns", "bytes"))
    place = np.arange(len(marks), dtype=np.int32)
    tasks = max(1, min(len(marks), max(parallel, math.ceil(size.sum() / GROUP_BYTES))))
    group = ((size.cumsum() - size) / max(1, size.sum()) * tasks).astype(np.int32)
    # a split that begins inside a record has the beginning of another if it leaves the field and enters one again
    begins = (inside != odd) & (~inside | turns)
    last = np.maximum.accumulate(np.where(begins, place, 0))
    begun = group[np.concatenate([place[:1], last[:-1]])]
    by_hash = np.argsort(marks)
    return _Splits(*(a[by_hash] for a in (marks, inside, first, place, group, begun))), tasks, free[0] if free else None


def _cut(splits: _Splits):
    """Lines to records and pieces of records: group, place of the split, number in it, kind, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, str]] = []
        held: list[str] = []
        now, at, place, number, open_, piece, header = None, 0, 0, 0, False, False, False

        def close(kind: int) -> None:
            nonlocal number, header
            text = "\n".join(held)
            held.clear()
            if header:
                header = False
            else:
                group = int(splits.group[at] if kind in (_WHOLE, _BEGINS) else splits.begun[at])
                out.append((group, place, number, kind, text.removesuffix("\r") if kind in (_WHOLE, _ENDS) else text))
                number += 1

        for batch in batches:
            odd = pc.bit_wise_and(pc.count_substring(batch.column(0), '"'), 1).to_pylist()
            for line, mark, flips in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), odd):
                if mark != now:
                    if held:
                        close(_GOES_ON if piece else _BEGINS)
                    at = int(np.searchsorted(splits.marks, mark))
                    now, place, number = mark, int(splits.place[at]), 0
                    open_, header = bool(splits.inside[at]), bool(splits.first[at])
                    piece = open_
                held.append(line)
                open_ ^= bool(flips)
                if not open_:
                    close(_ENDS if piece else _WHOLE)
                    piece = False
            if out:
                yield _batch(out)
        if held:
            close(_GOES_ON if piece else _BEGINS)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple[int, int, int, int, str]]) -> pa.RecordBatch:
    group, place, number, kind, text = zip(*rows)
    rows.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int32()), pa.array(place, pa.int32()), pa.array(number, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())],
        names=["group", "place", "number", "kind", "text"])


def _joined(header: str):
    """Kinds and texts of a group in file order to its records; the file to be written begins with the header, as one that was read does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[str] = []
        held: list[str] = []
        empty = True

        def close() -> None:
            out.append("\n".join(held))
            held.clear()

        def texts() -> pa.RecordBatch:
            nonlocal empty
            batch = pa.RecordBatch.from_arrays([pa.array([header, *out] if empty else out, pa.string())], names=["text"])
            empty = False
            out.clear()
            return batch

        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and kind in (_WHOLE, _BEGINS):  # the file before ended inside a field
                    close()
                held.append(text)
                if kind in (_WHOLE, _ENDS):
                    close()
            if out:
                yield texts()
        if held:
            close()
        if out:
            yield texts()

    return run


def split_records(spark: SparkSession, path: str, header: str) -> tuple[str, str] | None:
    """Write one record after the other in file order; the new path, and the character that ends a record.

    Each file that is written has the header; those of the files that are read, which are their first
    records, are left out. None if the text uses every such character.
    """
    lines = _lines(spark, path)
    splits, tasks, ending = _splits(lines, spark.sparkContext.defaultParallelism)
    if ending is None:
        return None
    cut = lines.select("value", "split").mapInArrow(_cut(splits), "group int, place int, number long, kind int, text string")
    out = scratch_path(spark, "records")
    # groups of neighbouring splits in order, so small splits do not make as many files and shuffle blocks
    ordered = cut.repartitionById(tasks, F.col("group")).sortWithinPartitions("place", "number").select("kind", "text")
    ordered.mapInArrow(_joined(header), "text string").write.text(out, compression="lz4", lineSep=ending)
    return out, ending
