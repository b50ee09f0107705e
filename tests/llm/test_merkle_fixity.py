import collections
import gzip
import tempfile

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from conftest import TABLES
from veritable.llm import merkle_fixity as W
from veritable.llm.queries import FIXITY_SQL, op9_merkle_fixity


@pytest.fixture(scope="module")
def records(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    path = tempfile.mkdtemp(prefix="run-") + "/records"
    W.archive(pages, ["page_id"], archive_bytes=50_000).write.parquet(path)
    return spark.read.parquet(path)


def test_offsets_are_gapless(records):
    ends = collections.defaultdict(int)
    for r in records.orderBy("archive", "offset").collect():
        assert r.offset == ends[r.archive] and r.length == len(r.record)
        ends[r.archive] += r.length
    assert len(ends) > 1


def test_equal_replicas_have_no_findings(records):
    assert W.audit(records, records).collect() == []


def test_faults_are_located(records):
    rows = records.orderBy("archive", "offset").collect()
    changed, lost = rows[3], rows[10]
    mine = lambda r: (F.col("archive") == r.archive) & (F.col("offset") == r.offset)
    replica = records.filter(~mine(lost)).withColumn("record", F.when(mine(changed), F.concat("record", F.lit(b"!"))).otherwise(F.col("record")))
    found = {(r.archive, r.offset, r.status) for r in W.audit(records, replica).collect()}
    assert found == {(changed.archive, changed.offset, "changed"), (lost.archive, lost.offset, "missing")}
    assert {r.status for r in W.audit(replica, records).collect()} == {"changed", "extra"}


def test_a_lost_archive(records):
    gone = records.orderBy("archive").first().archive
    found = W.audit(records, records.filter(F.col("archive") != gone)).collect()
    assert len(found) == records.filter(F.col("archive") == gone).count() and {r.status for r in found} == {"missing"}


def test_files_are_read_back(spark, records):
    folder, files = tempfile.mkdtemp(prefix="run-"), collections.defaultdict(bytes)
    rows = records.orderBy("archive", "offset").collect()
    for r in rows:
        files[r.archive] += bytes(r.record)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(gzip.compress(data) if name.endswith("0.warc") else data)
    back = W.read_archives(spark, folder).orderBy("archive", "offset").collect()
    assert [tuple(r) for r in back] == [(r.archive, r.offset, r.length, r.record) for r in rows]


def test_damaged_bytes_are_read_as_a_piece():
    assert [x[:2] for x in W.parse_archive(b"junkWARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\nrest")] == [(0, 4), (4, 37), (41, 4)]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", ""), (2, "v", "<p>ü</p>")], "page_id long, url string, html string")
    table = W.archive(pages, ["page_id", "url"])
    assert table.count() == 4 and W.audit(table, table, ["page_id"]).collect() == []
    assert W.audit(table.limit(0), table.limit(0)).collect() == []


def test_query_agrees_with_sql(spark):
    folder = TABLES.replace("0.001", "0.01")
    assert difference(op9_merkle_fixity(spark, folder), connect(folder), FIXITY_SQL) is None


def test_records_at_one_offset_meet_their_own_counterpart(spark):
    """Equal offsets, in both replicas or as copies: only what differs is found, whatever the columns are called."""
    def table(rows):
        return spark.createDataFrame(
            [("a", offset, len(text), bytearray(text.encode()), k, k) for k, (offset, text) in enumerate(rows)],
            "archive string, offset long, length long, record binary, copy int, found int")

    kept = table([(0, "one"), (0, "one"), (0, "two"), (9, "three"), (70_000, "x" * 3_000_000)])
    assert W.audit(kept, kept, ["copy", "found"]).count() == 0
    damaged = table([(0, "one"), (0, "one"), (0, "two"), (9, "thrEe"), (70_000, "x" * 3_000_000)])
    assert [(r.offset, r.status) for r in W.audit(kept, damaged, ["copy", "found"]).collect()] == [(9, "changed")]
    lost = table([(0, "one"), (0, "two"), (9, "three"), (9, "more"), (70_000, "x" * 3_000_000)])
    assert sorted((r.offset, r.status) for r in W.audit(kept, lost).collect()) == [(0, "missing"), (9, "extra")]
