import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from checks.compare import canonical
from odd_rows import odd_docs  # noqa: F401
from veritable.llm import decontamination
from veritable.llm.queries import LEAKS_SQL

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    """Every window of every item, looked for at every place of every document."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def given(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


TEXT = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_against_every_window(spark):
    items = [(1, TEXT), (2, "five SIX seven eight nine ten eleven twelve thirteen fourteen fifteen"), (3, "short item"), (10, "alpha"),
             (4, None), (5, ""), (6, "... !!"), (7, "same words same words same words same words same words same words"), (7, "more of seven"), (None, "nameless item here")]
    docs = [
        (1, f"before, {TEXT.upper()} after"), (2, "two three four five six seven eight nine ten"), (3, "a short item, ALPHA"),
        (4, "same words " * 20), (5, None), (6, ""), (7, "the nameless item here and more of seven"), (7, "the nameless item here and more of seven"),
        (None, "alpha"), (8, "one two three four five six seven eight nine TEN x five six seven eight nine ten eleven twelve thirteen fourteen"),
        (9, "Ümlaut alphaÉ short-item"), (10, " ".join(f"w{i}" for i in range(30_000)) + " " + TEXT),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.overlaps(d, b)
    assert given(found) == plain(docs, items)
    spans = {r["doc_id"]: [(s["low"], s["end"]) for s in r["spans"]] for r in found.collect()}
    assert spans[1] == [(1, 15)] and spans[3] == [(1, 4)] and spans[4] == [(0, 40)] and spans[5] == []
    assert spans[8] == [(0, 10), (11, 21)]


def test_shared_passages_of_each_length(spark):
    """A span of ten words is found wherever it lies; one of nine never is."""
    import random

    draw = random.Random(5)
    items = [(i, " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 40)))) for i in range(40)]
    docs = []
    for i in range(120):
        own = [draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(0, 60))]
        w = draw.choice(items)[1].split()
        a = draw.randrange(len(w))
        at = draw.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + w[a : a + draw.randint(1, 25)] + own[at:])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = given(decontamination.overlaps(d, b))
    assert got == plain(docs, items)
    assert {row[5] for row in got} == {True, False}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    items = [(i, f"{TEXT} {i} {i * 7} and the end") for i in range(30)]
    docs = [(i, f"x{i} y {TEXT} {i} z") for i in range(20)] + [(99, "nothing of it here, not one window at all, in this text")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "FILTER_LONGS", 1)
    assert given(decontamination.overlaps(d, b)) == plain(docs, items)


def test_odd_rows_clashing_names_and_sql(spark, odd_docs, tmp_path):
    bench = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog the quick", "x", 1), (None, "word1 and then", None, None), (3, None, None, None)],
        "item_id long, text string, key string, rid int")
    docs = odd_docs.withColumns({"rid": F.lit(1), "key": F.lit("k"), "w": F.lit("w"), "print": F.lit(3), "asked": F.lit(None)})
    got = decontamination.overlaps(docs, bench)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert given(got) == plain(rows, items)
    con = duckdb.connect()
    docs.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    bench.toPandas().to_parquet(tmp_path / "b.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM '{tmp_path}/d.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT CAST(item_id AS BIGINT) AS item_id, text FROM '{tmp_path}/b.parquet'")
    result = con.execute(LEAKS_SQL)
    want = canonical([x[0] for x in result.description], result.fetchall())
    small = got.drop("spans")
    assert canonical(small.columns, [tuple(r) for r in small.collect()]) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    assert decontamination.overlaps(none, bench).count() == 0
    empty = decontamination.overlaps(docs, bench.limit(0))
    assert given(empty) == plain([(1, TEXT), (2, None)], [])
