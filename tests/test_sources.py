import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritable import ROW_ID, Dataset
from veritable.operators import profile
from veritable.plans.report import build_report
from veritable.sources import records, row_ids, sinks, versions
from veritable.sources.delimited import guess_separator, header_names, scan_delimited, scan_text, validate
from veritable.sources.synthetic import uniform_table


def write(path, text):
    path.write_text(text)
    return str(path)


def test_types_come_from_all_rows(spark, tmp_path):
    text = "n,x,d,t,clock,flag,s\n1,1.5,2024-01-01,2024-01-01 10:00:00.25,12:30:00,true,a\n2,2,2024-01-02,2024-01-02 11:00:00,13:00:00,false,b\n"
    df = scan_delimited(spark, write(tmp_path / "a.csv", text))
    ds = Dataset.of(df.selectExpr("*", f"0L AS {ROW_ID}"))
    assert {c.name: c.kind for c in ds.columns} == {
        "n": "number", "x": "number", "d": "date", "t": "date", "clock": "text", "flag": "text", "s": "text",
    }
    assert df.first().t == dt.datetime(2024, 1, 1, 10, 0, 0, 250_000) and df.first().clock == "12:30:00"


def test_impossible_dates_stay_text(spark, tmp_path):
    df = scan_delimited(spark, write(tmp_path / "a.csv", "d,v\n2024-01-31,1\n2024-01-32,2\n"))
    assert df.schema["d"].dataType.simpleString() == "string"


def test_ragged_rows_and_repeated_names(spark, tmp_path):
    df = scan_delimited(spark, write(tmp_path / "a.csv", "name,Name,,v\na,b,c,1\nd\ne,f,g,2,extra\n"))
    assert df.columns == ["name", "Name_1", "column2", "v", "column4"]
    assert sorted(map(tuple, df.collect()), key=str) == [
        ("a", "b", "c", 1, None), ("d", None, None, None, None), ("e", "f", "g", 2, "extra"),
    ]
    assert df.count() == 3


def test_quoted_fields_may_span_lines(spark, tmp_path):
    df = scan_delimited(spark, write(tmp_path / "a.csv", 'a,b\n"one\ntwo","say ""hi"", ok"\nx,y\n'))
    assert sorted(map(tuple, df.collect())) == [("one\ntwo", 'say "hi", ok'), ("x", "y")]


@pytest.mark.parametrize("name, sep", [("a.tsv", "\t"), ("a.txt", ";"), ("b.txt", "|")])
def test_separator_is_guessed(spark, tmp_path, name, sep):
    text = f"a{sep}b\n1{sep}x\n2{sep}y\n"
    assert [tuple(r) for r in scan_delimited(spark, write(tmp_path / name, text)).collect()] == [(1, "x"), (2, "y")]


def test_row_cap(spark, tmp_path):
    path = write(tmp_path / "a.csv", "n\n" + "\n".join(map(str, range(100))))
    assert [r.n for r in scan_delimited(spark, path, row_cap=3).collect()] == [0, 1, 2]


def test_pasted_text(spark):
    df = scan_text(spark, 'a\tb\n1\t"x\ny"\n2\tz\n')
    assert [tuple(r) for r in df.collect()] == [(1, "x\ny"), (2, "z")]
    with pytest.raises(ValueError):
        scan_text(spark, " \n ")


def test_header_helpers():
    assert guess_separator('"a,b"\tc') == "\t" and guess_separator("only") == ","
    assert header_names("a,A,a,", ",", 5) == ["a", "A_1", "a_2", "column3", "column4"]


def test_validation(spark, tmp_path):
    with pytest.raises(ValueError, match="no data rows"):
        validate(scan_delimited(spark, write(tmp_path / "a.csv", "a,b\n")))
    with pytest.raises(ValueError, match="header"):
        validate(scan_delimited(spark, write(tmp_path / "b.csv", ",,\n1,2,3\n")))
    with pytest.raises(ValueError, match="empty"):
        scan_delimited(spark, write(tmp_path / "c.csv", ""))


def test_row_ids_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1_000, 1, 7).withColumnRenamed("id", "n").write.parquet(path)
    for split in ("128m", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        pairs = row_ids.read_with_row_ids(spark, path).select("n", ROW_ID).collect()
        assert sorted(p[1] for p in pairs) == list(range(1_000)) and all(n == i for n, i in pairs)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_ids_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(row_ids, "BROADCAST_FILES", 0)
    df = spark.range(0, 100, 1, 3).withColumnRenamed("id", "n")
    stored = row_ids.write_with_row_ids(df, str(tmp_path / "t"))
    assert {r.n: r[ROW_ID] for r in stored.collect()} == {i: i for i in range(100)}


def test_export_reads_back(spark, make, tmp_path):
    rows = [
        (1, ' padded "quote", comma ', 1.5, dt.datetime(2024, 1, 1, 10, 0, 0, 5), dt.date(2024, 1, 1)),
        (2, "line\nbreak", None, dt.datetime(2024, 1, 2, 10), None), (3, None, 2.0, None, dt.date(2024, 1, 3)),
    ]
    ds = make(rows, "n int, s string, x double, ts timestamp_ntz, d date")
    sinks.export_view(ds, str(tmp_path / "out"), "x", "desc")
    back = scan_delimited(spark, str(tmp_path / "out"))
    assert back.columns == ds.names and back.exceptAll(ds.values()).count() == 0 and back.count() == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert [line[0] for line in text.splitlines() if line[:2] in ("1,", "2,", "3,")] == ["3", "1", "2"]


def test_refresh_replaces_and_survives_failure(spark, tmp_path):
    root = str(tmp_path / "data")
    with pytest.raises(ValueError):
        versions.current(spark, root)

    def csv(rows):
        return lambda: scan_delimited(spark, write(tmp_path / "in.csv", "k,v\n" + "".join(f"a{i},{i}\n" for i in range(rows))))

    assert versions.refresh(spark, root, csv(40)).count_rows() == 40
    old = versions.current(spark, root)
    assert versions.refresh(spark, root, csv(60)).count_rows() == 60
    assert versions.current(spark, root).count_rows() == 60 and old.count_rows() == 40
    with pytest.raises(ValueError):
        versions.refresh(spark, root, csv(0))
    assert versions.current(spark, root).count_rows() == 60


def test_report_is_stored_and_read_back(spark, make, tmp_path):
    path = str(tmp_path / "reports")
    for name in ("one", "two"):
        ds = make([(i + 0.5, "a" if i % 3 else "b") for i in range(40)], "x double, s string", name)
        sinks.save_report(build_report(ds), path)
    stored = sinks.load_report(spark, path, "two")
    assert {r.dataset_id for r in stored.collect()} == {"two"}
    assert [r.id for r in stored.collect()][0] == "executive_summary"


def test_uniform_table(spark):
    end = dt.datetime(2025, 1, 1)
    df = uniform_table(spark, 5_000, seed=3, end=end)
    row = profile.aggregate_once(Dataset.of(df), profile.Measures({
        "rows": F.count("*"), "lo": F.min("value"), "hi": F.max("value"),
        "first": F.min("timestamp"), "last": F.max("timestamp"), "ids": F.max("id"),
        "kinds": F.count_distinct("category"),
    }, [])).first()
    assert (row.rows, row.ids, row.kinds) == (5_000, 5_000, 4) and 0 <= row.lo < 1 and 99 < row.hi <= 100
    assert end - dt.timedelta(days=1825) <= row.first and row.last <= end
    assert df.exceptAll(uniform_table(spark, 5_000, seed=3, end=end)).count() == 0


def test_zoned_moments_are_read_in_utc(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at\n1,2024-01-01T00:00:00+02:00\n2,2024-06-01T12:00:00Z\n3,2024-06-01 01:02:03\n4,\n")
    table = scan_delimited(spark, str(tmp_path))
    found = [r["at"] for r in table.orderBy("id").collect()]
    assert found == [dt.datetime(2023, 12, 31, 22), dt.datetime(2024, 6, 1, 12), dt.datetime(2024, 6, 1, 1, 2, 3), None]


def test_cells_beyond_the_header_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n6\n7,"x,y,z","u,v",w\n')
    table = scan_delimited(spark, str(tmp_path))
    assert table.columns == ["a", "b", "column2", "column3"]
    assert [tuple(r) for r in table.orderBy("a").collect()] == [
        (1, "2", None, None), (3, "4", "5", None), (6, None, None, None), (7, "x,y,z", "u,v", "w"),
    ]


def test_quoted_separators_add_no_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x,y,z"\n2\n')
    assert scan_delimited(spark, str(tmp_path)).columns == ["a", "b"]


def test_files_are_numbered_by_part(spark, tmp_path):
    for name, low in (("part-99999-x.parquet", 0), ("part-100000-x.parquet", 3), ("part-00002-x.parquet", 9), ("other.parquet", 20)):
        one = str(tmp_path / "one" / name)
        spark.range(low, low + 3).coalesce(1).write.parquet(one)
        (tmp_path / "t").mkdir(exist_ok=True)
        next((tmp_path / "one" / name).glob("part-*.parquet")).rename(tmp_path / "t" / name)
    found = row_ids.read_with_row_ids(spark, str(tmp_path / "t")).orderBy(ROW_ID).collect()
    assert [r.id for r in found] == [9, 10, 11, 0, 1, 2, 3, 4, 5, 20, 21, 22]


def test_a_version_is_written_once(spark, tmp_path):
    stored = row_ids.write_with_row_ids(spark.range(100).repartition(4), str(tmp_path / "v"))
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["offsets", "raw"]
    assert sorted(r[0] for r in stored.select(ROW_ID).collect()) == list(range(100))


def test_an_older_load_does_not_hide_a_newer_one(spark, tmp_path):
    root = str(tmp_path / "race")

    def slow():
        versions.refresh(spark, root, lambda: spark.range(2))
        return spark.range(1)

    versions.refresh(spark, root, slow)
    assert versions.current(spark, root).count_rows() == 2


def test_multiline_records_across_splits(spark, tmp_path):
    """Files cut into splits of a few bytes give the records of the csv module, in file order."""
    import csv
    import random

    draw = random.Random(4)
    piece = lambda: "".join(draw.choice(["a", "b", " ", "\n", '"', ",", "é", "漢", "\r\n", "long " * 40]) for _ in range(draw.randint(0, 9)))
    rows = [(str(i), f"x{piece()}y", piece() + "z") for i in range(400)] + [("400", "x" + "line\n" * 3_000 + "y", "z")]
    rows += [(str(i), "plain", "z") for i in range(401, 420)]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        with open(folder / f"f{k}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["id", "body", "more"])
            writer.writerows(rows[k::3])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        df = scan_delimited(spark, str(folder))
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert df.columns == ["id", "body", "more"]
    assert sorted(got) == sorted((int(a), b, c) for a, b, c in rows)


def test_ragged_line_with_many_quoted_separators(spark, tmp_path):
    wide = ",".join(str(i) for i in range(9))
    df = scan_delimited(spark, write(tmp_path / "a.csv", f'a,b\n1,2\n3,"{"," * 20_000}",x,"q""u,""",{wide}\n'))
    assert len(df.columns) == 13
    assert sorted(len(r.b) for r in df.select("b").collect()) == [1, 20_000]


def test_interleaved_writers_take_numbers_of_their_own(spark, tmp_path):
    """One load begins while another is under way, more run side by side: every version has its own number."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "data")

    def outer():
        versions.refresh(spark, root, lambda: spark.range(5).withColumnRenamed("id", "n"))
        return spark.range(3).withColumnRenamed("id", "n")

    versions.refresh(spark, root, outer)
    assert versions.current(spark, root).count_rows() == 5
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: versions.refresh(spark, root, lambda: spark.range(k + 1).withColumnRenamed("id", "n")), range(4)))
        numbers = list(pool.map(lambda _: versions.take_number(spark, root), range(8)))
    log = sorted(r.version for r in versions._log(spark, root).collect())
    assert len(set(log)) == len(log) == 6 and len(set(numbers)) == 8 and not set(numbers) & set(log)


def test_replaced_versions_expire(spark, tmp_path):
    import datetime as dt
    import os

    root = str(tmp_path / "data")
    for k in (1, 2, 3):
        versions.refresh(spark, root, lambda: spark.range(k).withColumnRenamed("id", "n"))
    assert versions.expire(spark, root, dt.timedelta(hours=1)) == []
    assert versions.expire(spark, root, dt.timedelta(0)) == [1, 2]
    assert versions.expire(spark, root, dt.timedelta(0)) == [] and len(os.listdir(f"{root}/data")) == 1
    assert versions.current(spark, root).count_rows() == 3


def _split_small(spark, run):
    """Files are cut into splits of 700 bytes meanwhile."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("group_bytes, files", [(None, 4), (5_000, 9)])
def test_small_splits_are_stored_in_groups(spark, tmp_path, monkeypatch, group_bytes, files):
    """Records in file order in a few files of like size, each with the header; one record goes on through whole groups."""
    rows = [f'{i},"{"line" * (i % 50)}\n{i}"' for i in range(300)]
    rows[150] = '150,"' + "line\n" * 3_000 + '150"'
    path = write(tmp_path / "one.csv", "\n".join(["id,body", *rows]) + "\n")
    if group_bytes:
        monkeypatch.setattr(records, "GROUP_BYTES", group_bytes)
    out, ending = _split_small(spark, lambda: records.split_records(spark, path, "id,body"))
    stored = spark.read.text(out, lineSep=ending).select("value", "_metadata.file_name").collect()
    names = sorted({r.file_name for r in stored})
    # all pieces of the long record are where it begins, so that the groups inside it have no file
    assert 3 <= len(names) <= files
    found = [[r.value for r in stored if r.file_name == name] for name in names]
    assert all(part[0] == "id,body" for part in found)
    assert [value for part in found for value in part[1:]] == rows


def test_a_file_that_ends_inside_a_field(spark, tmp_path):
    (tmp_path / "open").mkdir()
    write(tmp_path / "open" / "a.csv", 'id,body\n1,x\n2,"' + "open\n" * 500)
    write(tmp_path / "open" / "b.csv", 'id,body\n3,y\n4,"' + "shut\n" * 500 + '"\n5,z\n')
    out, ending = _split_small(spark, lambda: records.split_records(spark, str(tmp_path / "open"), "id,body"))
    got = sorted(r.value for r in spark.read.text(out, lineSep=ending).collect() if r.value != "id,body")
    # the text of a file's last line has no line break of its own
    assert got == ["1,x", '2,"' + "\n".join(["open"] * 500), "3,y", '4,"' + "shut\n" * 500 + '"', "5,z"]


def test_csv_multiline_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The query's own files are as many as the parts of its table; none holds it whole."""
    import checks.views

    rows = [(i, f'a "{i}"\nb, c' if i % 7 else "", i) for i in range(80)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartitionByRange(8, "doc_id")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(checks.views, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = checks.views.csv_multiline(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, f'first\n"{text}",\n', n) for i, text, n in rows]
    assert len(list((tmp_path / "csv_multiline").glob("part-*"))) > 1
