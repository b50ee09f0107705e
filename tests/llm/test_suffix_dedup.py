import collections
import hashlib
import random
import re

import pytest

from veritable.llm import suffix_dedup as S
from odd_rows import odd_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=50):
    words = {(i, t or ""): WORD.findall(t or "") for i, t in rows}
    places = collections.defaultdict(list)
    for (i, t), w in words.items():
        for s in range(len(w) - size + 1):
            places[tuple(w[s : s + size])].append((i, hashlib.md5(t.encode()).digest(), s, t))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, _, s, t in sorted(found)[1:]:
            gone[i, t] |= set(range(s, s + size))
    return sorted((i, len(words[i, t or ""]), tuple(sorted(gone[i, t or ""]))) for i, t in rows)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(1)
    passages = [[f"w{pick.randint(0, 2)}" for _ in range(200)] for _ in range(3)]
    out = []
    for n in range(60):
        a, b = pick.choice(passages), pick.choice(passages)
        at, to = pick.randint(0, 150), pick.randint(0, 120)
        words = [f"x{n}", *a[at : at + pick.randint(10, 90)], *b[to : to + pick.randint(5, 80)], *["z"] * pick.choice([0, 3, 70])]
        out.append((n, " ".join(words)))
    alone = " ".join(f"q{k}" for k in range(60))
    return [*out, (900, None), (901, ""), (902, alone), (902, alone), (903, " ".join(f"u{k}" for k in range(49)))]


def test_repeats_are_exactly_the_later_windows(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.low, s.end))) for r in S.repeats(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_texts_without_their_repeats(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars long")
    left = sorted((r.doc_id, tuple(WORD.findall(r.text or "")), r.n_chars, r.text) for r in S.remove_repeats(docs).collect())
    texts = dict(rows)
    want = []
    for i, n, gone in brute(rows):
        words = [w for k, w in enumerate(WORD.findall(texts[i] or "")) if k not in gone]
        if words or not n:
            want.append((i, tuple(words)))
    assert [x[:2] for x in left] == sorted(want)
    assert all(n == (None if t is None else len(t)) for _, _, n, t in left)


def test_odd_rows(odd_docs):
    assert S.repeats(odd_docs).count() == odd_docs.count()
    assert S.remove_repeats(odd_docs).columns == odd_docs.columns
    assert S.repeats(odd_docs.limit(0)).collect() == [] and S.remove_repeats(odd_docs.limit(0)).collect() == []


def thue_morse(n, a, b):
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_words_and_runs_that_cancel_out_in_polynomial_hashes(spark):
    """Thue-Morse words and runs of words: equal by any polynomial modulo a power of two, yet different."""
    n = 1024
    words = ["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))]
    filler = [f"f{k}" for k in range(49)]
    rows = [(k, " ".join([*filler[:30], w, *filler[30:]])) for k, w in enumerate(words)]
    rows += [(5 + k, " ".join(thue_morse(n, x, y))) for k, (x, y) in enumerate([("p", "q"), ("q", "p")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for size in (50, 1024):
        got = sorted((r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.low, s.end))) for r in S.repeats(docs, min_words=size).collect())
        assert got == brute(rows, size)
