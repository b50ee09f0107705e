import math
import random

import pytest

from veritable.llm import exact_topk as K


def brute(rows, k, every):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in usable if i % every == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10, every=10, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, id string")
    vectors = K.whole_vectors(table)
    return sorted(tuple(r) for r in K.top_k(vectors, vectors.filter(vectors["id"] % every == 0), k, **sizes).collect())


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    f = lambda: [round(pick.uniform(-1, 1) * 64) / 64 for _ in range(6)]
    same = f()
    out = [(i, f() if i % 3 else same) for i in range(120)]
    out += [(200, None), (201, [0.5, None, 0.1, 0.1, 0.1, 0.1]), (202, [float("nan")] * 6), (210, [float("inf")] * 6), (None, same)]
    out += [(220, [0.25, -0.5]), (221, [0.25, 0.5]), (230, []), (30, out[30][1])]
    return [(i, v, "clash", "clash") for i, v in out]


def test_scores_ties_and_unusable_vectors(spark, rows):
    assert run(spark, rows, block_rows=16, query_rows=4) == brute([r[:2] for r in rows], 10, 10)


def test_fewer_candidates_than_k(spark, rows):
    few = rows[:5]
    assert run(spark, few, k=10) == brute([r[:2] for r in few], 10, 10)


def test_large_components_are_exact(spark):
    big = [(i, [2.0**20 + i * 1024, 2.0**19 - i], "c", "c") for i in range(12)]
    assert run(spark, big, k=3) == brute([r[:2] for r in big], 3, 10)


def test_empty_table(spark, rows):
    assert run(spark, [(1, None, "", "")]) == []
