import collections
import re

from conftest import TABLES
from veritable.llm import quality_rules as Q
from odd_rows import odd_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = len(lines) - len(set(lines))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    chars = sum(map(len, words))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    capitals = sum(c in Q.CAPITALS for c in text)
    bad = (
        base or 100 * symbols > 20 * len(words) or 100 * dup > 40 * len(lines) or 100 * capitals > 40 * chars
        or 100 * text.count("!") > 30 * len(words) or chars < 2 * len(words) or chars > 25 * len(words)
    )
    return len(words), chars, symbols, dup, len(covered), base, not bad


def measured(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return [(r["doc_id"], tuple(r[n] for n in names)) for r in Q.measure(docs).collect()]


def expected(docs):
    return [(r.doc_id, brute(r.text)) for r in docs.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


def test_measures_and_verdict(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert sorted(measured(docs), key=key) == sorted(expected(docs), key=key)


def test_odd_rows(odd_docs):
    assert sorted(measured(odd_docs), key=key) == sorted(expected(odd_docs), key=key)


def test_filter_keeps_columns_and_agrees(odd_docs):
    kept = Q.filter_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, m in expected(odd_docs) if m[-1])


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = {r.doc_id for r in Q.filter_quality(docs, tuple(reversed(Q.RULES))).collect()}
    assert kept == {i for i, m in expected(docs) if m[-1]}


def test_empty_table(odd_docs):
    assert measured(odd_docs.limit(0)) == []
    assert Q.filter_quality(odd_docs.limit(0)).count() == 0


def test_every_row_has_every_measure(odd_docs):
    """Also texts that the first rule rejects: the query returns the measures of the method's own rules."""
    names = ["n_lines", "n_capitals", "n_shouts"]
    got = [(r["doc_id"], tuple(r[n] for n in names)) for r in Q.measure(odd_docs).collect()]

    def plain(text):
        text = text or ""
        return sum(bool(WORD.search(line)) for line in text.split("\n")), sum(c in Q.CAPITALS for c in text), text.count("!")

    assert sorted(got, key=key) == sorted(((r.doc_id, plain(r.text)) for r in odd_docs.collect()), key=key)
    assert Q.measure(odd_docs).columns == ["doc_id", *Q.MEASURES, "base_failed", "kept"]
