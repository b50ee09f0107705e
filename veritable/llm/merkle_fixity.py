"""Merkle fixity audit of WARC archives and their replicas.

A record's leaf is the SHA-256 of its bytes. Records whose offsets fall into one range of the
archive are hashed in order of offset into the range's node; a fixed number of neighbouring
nodes are hashed into the node above, up to one root for each archive. Two replicas are compared
by their roots; only below nodes that differ are children compared, down to the records.

Everything is keyed by (archive, range), so an archive of any size spreads over many tasks, and a
node gathers a range's records or a few children, whose number is bounded by the sizes chosen.

Defined cases: a null payload or address counts as empty. Repeated rows are records of their own
at their own offsets. An empty table gives no archive and no findings. Records with equal offset
in one archive are ordered by length and digest. Other columns are ignored unless named to be
carried.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.shared import stored

RANGE_BYTES = 1 << 16
FANOUT = 16
ARCHIVE_BYTES = 1 << 24


def record_bytes(url: Column, payload: Column, kind: str = "text/html") -> Column:
    """A WARC response record of a payload."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit(f"\r\nContent-Type: {kind}\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    ).cast("binary")


def archive(pages: DataFrame, order: Sequence[str], url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Records laid out in archives of about `archive_bytes`: archive, offset, length, record, and `order`.

    Rows are sorted over the whole table by `order`; each task lays out its rows one after the other.
    """
    names = list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            archives, offsets, lengths = [], [], []
            for size in batch.column("record").to_pylist():
                if at and at + len(size) > archive_bytes:
                    number, at = number + 1, 0
                archives.append(f"{part:06d}-{number:06d}.warc")
                offsets.append(at)
                lengths.append(len(size))
                at += len(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(archives, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), *batch.columns],
                names=["archive", "offset", "length", *batch.schema.names])

    rows = pages.select(record_bytes(F.col(url), F.col(payload)).alias("record"), *names)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ties go by a hash of the record: sort keys are sampled on the driver, so they must be short
    keys = [*names, F.xxhash64("record")]
    spread = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread.mapInArrow(run, f"archive string, offset long, length long, {kinds}")


def parse_archive(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record; what is no record is one piece up to the next or the end."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[at:head]) if data.startswith(b"WARC/", at) and head >= 0 else None
        if size:
            end = min(head + 4 + int(size[1]) + 4, len(data))
        else:
            following = data.find(b"WARC/", at + 1)
            end = following if following >= 0 else len(data)
        yield at, end - at, data[at:end]
        at = end


def read_archives(spark, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: archive, offset in the unpacked file, length, record.

    A file is one row here, so archives should have the usual size of at most about 1 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for offset, length, record in parse_archive(data):
                    yield pa.RecordBatch.from_pydict({
                        "archive": [name.rsplit("/", 1)[-1]], "offset": pa.array([offset], pa.int64()), "length": pa.array([length], pa.int64()), "record": [record]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, record binary")


def leaves(records: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Digest of each record, and the range its offset falls into."""
    return records.select("archive", "offset", "length", F.sha2("record", 256).alias("digest"), (F.floor(F.col("offset") / RANGE_BYTES)).cast("long").alias("node"), *carry)


def _nodes(rows: DataFrame, *parts: str) -> DataFrame:
    """One hash of the ordered parts of each node."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda s: F.concat_ws(":", *[s[p].cast("string") for p in parts])), "|")
    return rows.groupBy("archive", "node").agg(F.sha2(joined, 256).alias("hash"))


def tree(records: DataFrame, name: str) -> list[DataFrame]:
    """Node hashes by level, ranges first, one root for each archive last."""
    levels = [stored(_nodes(records, "offset", "length", "digest"), f"{name}-0")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        up = levels[-1].select("archive", F.col("node").alias("child"), "hash", F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
        levels.append(stored(_nodes(up, "child", "hash"), f"{name}-{len(levels)}"))
        last //= FANOUT
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    other = right.withColumnRenamed("hash", "other")
    return left.join(other, ["archive", "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node")


def audit(kept: DataFrame, replica: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Records that differ between an archive and its replica, found from the roots down.

    `status` is changed, missing (the replica lacks the record) or extra (only the replica has one
    there). Columns in `carry` come from the archive's side.
    """
    a, b = stored(leaves(kept, carry), "fixity-leaves"), stored(leaves(replica), "fixity-replica-leaves")
    left, right = tree(a, "fixity-tree"), tree(b, "fixity-replica-tree")
    while len(left) < len(right):
        left.append(_above(left[-1]))
    while len(right) < len(left):
        right.append(_above(right[-1]))
    bad = _differing(left[-1], right[-1])
    for level in range(len(left) - 2, -1, -1):
        parent = F.floor(F.col("node") / FANOUT).cast("long")
        above = bad.withColumnRenamed("node", "up")
        under = [x[level].withColumn("up", parent).join(above, ["archive", "up"], "left_semi").drop("up") for x in (left, right)]
        bad = stored(_differing(*under), f"fixity-bad-{level}")
    # equal records at one offset cancel out, as often as both sides have them; what is left there is
    # numbered by length and digest, and a record meets the one of its number
    each, left_over = ["archive", "offset", "length", "__sum"], ["archive", "offset", "__place"]
    place = F.row_number().over(Window.partitionBy("archive", "offset").orderBy("length", "__sum", "__copy"))
    mine, theirs = [
        x.join(bad, ["archive", "node"], "left_semi").drop("node").withColumn("__sum", F.coalesce("digest", F.lit(""))).withColumn(
            "__copy", F.row_number().over(Window.partitionBy(*each).orderBy(*[c for c in carry if c in x.columns], "length"))) for x in (a, b)
    ]
    mine, theirs = [
        x.join(y.select(*each, "__copy"), [*each, "__copy"], "left_anti").withColumn("__place", place).drop("__sum", "__copy") for x, y in ((mine, theirs), (theirs, mine))
    ]
    found = theirs.select(*left_over, F.col("length").alias("found_length"), F.col("digest").alias("found_digest"), F.lit(True).alias("__found"))
    met = mine.withColumn("__kept", F.lit(True)).join(found, left_over, "full")
    return met.withColumn("status", F.when(F.col("__found").isNull(), "missing").when(F.col("__kept").isNull(), "extra").otherwise("changed")).drop("__place", "__kept", "__found")


def _above(level: DataFrame) -> DataFrame:
    up = level.select("archive", F.col("node").alias("child"), "hash", F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
    return _nodes(up, "child", "hash")
