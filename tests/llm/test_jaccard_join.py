import random
import re

import pytest

from veritable.llm import jaccard_join as J
from veritable.llm.components import components
from odd_rows import odd_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, threshold=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    classes = {}
    for i, s in sets:
        if s:
            classes.setdefault(s, []).append(i)
    names = list(classes)
    parent = list(range(len(names)))
    links = [set() for _ in names]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if len(names[a] & names[b]) / len(names[a] | names[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
                parent[root(a)] = root(b)
    first = {}
    for k, s in enumerate(names):
        first[root(k)] = min(first.get(root(k), 10**9), *classes[s])
    out = []
    for i, s in sets:
        if not s:
            out.append((i, i, 0, 0, i))
            continue
        k = names.index(s)
        copies = sum(len(classes[names[m]]) for m in links[k]) + len(classes[s]) - 1
        out.append((i, min(classes[s]), len(links[k]), copies, first[root(k)]))
    return sorted(out)


@pytest.fixture(scope="module")
def edited():
    pick = random.Random(4)
    rows = []
    for k in range(12):
        base = [f"v{pick.randint(0, 400)}" for _ in range(pick.choice([8, 60, 120, 200]))]
        for _ in range(pick.choice([1, 2, 9])):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                words[pick.randrange(len(words))] = f"e{pick.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, "a b c"), (1001, "a b  c"), (1002, ""), (1003, None), (1004, "\n"), (1005, rows[0][1]), (1005, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [2, 1024])
def test_classes_links_and_groups(spark, edited, block):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    got = sorted(tuple(r) for r in J.join(docs, block_texts=block).collect())
    assert got == brute(edited)


def test_one_document_of_each_group_stays(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.drop_near_duplicates(docs).collect())
    assert kept == sorted({group for _, _, _, _, group in brute(edited)})


def test_odd_rows(odd_docs):
    rows = J.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    kept = J.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 1").count() == 1
    assert J.join(odd_docs.limit(0)).collect() == [] and J.drop_near_duplicates(odd_docs.limit(0)).collect() == []


def test_chance_of_a_shared_prefix():
    assert J.chance(0.8, 4, J.TREES) >= J.RECALL > J.chance(0.8, 5, J.TREES)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(41)} | {(100 + k, 100) for k in range(30)}


def test_blocks_are_bounded_in_bytes(spark, edited, monkeypatch):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK_BYTES", 900)
    assert sorted(tuple(r) for r in J.join(docs).collect()) == brute(edited)


def test_long_words_that_cancel_out_in_polynomial_hashes(spark):
    marks = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(n, "same four words here " + "".join("ab"[m ^ n] for m in marks)) for n in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in J.join(docs).collect()) == brute(rows)


def signed(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "i long, t string").withColumn("tid", F.unhex(F.md5("t")))
    found = J.signatures(docs, J.TREES, J.DEPTH, 5).filter("node is not null")
    return found, {bytes(r.node): r.i for r in found.select("node", "i").collect()}


def replaced(words, count, step):
    """The words with `count` of them replaced, far apart: 5 * count shingles differ."""
    out = list(words)
    for k in range(count):
        out[5 + step * k] = f"r{k}"
    return " ".join(out)


def test_prefixes_are_shortened_for_the_classes_that_need_it(spark):
    """Near copies settle at full depth and do not meet again; pairs near the threshold are met by shorter prefixes."""
    rows = []
    for n in range(60):
        words = [f"g{n}x{k}" for k in range(300)]
        rows += [(4 * n, " ".join(words)), (4 * n + 1, replaced(words, 1, 6))]
        words = [f"h{n}x{k}" for k in range(300)]
        rows += [(4 * n + 2, " ".join(words)), (4 * n + 3, replaced(words, 6, 12))]
    found, ids = signed(spark, rows)
    edges = J.candidates(found.select("node", "paths", "sketch"), 0.8, J.TREES, J.DEPTH, J.RECALL).collect()
    depths = {}
    for e in edges:
        a, b = sorted((ids[bytes(e.a)], ids[bytes(e.b)]))
        assert a // 2 == b // 2
        if a < b:
            depths.setdefault((a, b), set()).add(e.depth)
    assert set(depths) == {(k, k + 1) for k in range(0, 240, 2)}
    assert all(depths[4 * n, 4 * n + 1] == {6} for n in range(60))
    assert any(min(depths[4 * n + 2, 4 * n + 3]) < 6 for n in range(60))
    assert J.settled_within(6, 20, 6, J.RECALL) < J.settled_within(5, 20, 6, J.RECALL)


def test_a_shared_passage_links_no_candidates(spark):
    passage = [f"p{k}" for k in range(50)]
    rows = [(n, " ".join([*(f"a{n}x{k}" for k in range(75)), *passage, *(f"b{n}x{k}" for k in range(75))])) for n in range(600)]
    found, _ = signed(spark, rows)
    assert J.candidates(found.select("node", "paths", "sketch"), 0.8, J.TREES, J.DEPTH, J.RECALL).count() <= 6


def test_a_large_group_met_across_batches(spark):
    """Chains of copies that drift: each is near the one before, leaders are compared across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        words = [f"w{k}" for k in range(200)]
        rows = []
        for n in range(90):
            words[(7 * n) % 200] = f"e{n}"
            rows.append((n, " ".join(words)))
        got = sorted(tuple(r) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), block_texts=16).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)
