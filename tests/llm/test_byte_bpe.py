import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import TABLES
from veritable.llm import byte_bpe as B
from odd_rows import odd_docs  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def check(reference, docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in B.digests(docs, PATH, public_tokenizers.PATTERN).collect())
    assert got == sorted(((r.doc_id is None, r.doc_id or 0), expected(reference, r.text)) for r in docs.collect())


def test_documents(spark, reference):
    check(reference, spark.read.parquet(f"{TABLES}/documents.parquet"))


def test_odd_rows(odd_docs, reference):
    check(reference, odd_docs)
    assert B.digests(odd_docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_odd_texts_and_round_trip(spark, reference):
    pick = random.Random(3)
    parts = [*"ab  \n\t\r'sx.,!  \u0085é漢字١٢    \x1c\x00'll", "<|endoftext|>", "aaaaaaaa", " " * 7, "\n \n"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 5000 + " " * 3000 + "b" * 300, "ab" * 3000, "", " ", "\n", "thethethe" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(reference, docs)
    tokens = B.encode(docs, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: list(r.ids) for r in tokens.collect()} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}
    back = B.decode(tokens, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.text).decode() for r in back.collect()} == dict(enumerate(texts))


def test_texts_whose_polynomial_hashes_meet(spark, reference):
    """Thue-Morse words and their complements, and long texts without blanks, in one partition."""
    rows, word = [], "a"
    while len(word) < 65_536:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 1_024:
            rows += [(2 * len(rows), word), (2 * len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    rows += [(1_000 + i, chr(0x4E00 + i) * 3_000 + chr(0x4F00 + i)) for i in range(6)]
    check(reference, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def test_a_full_cache_and_equal_hashes_change_nothing(monkeypatch, reference):
    import numpy as np

    from veritable.llm import pieces

    texts = [f"word{i % 50} and {'tail' * (i % 7)} ünï " * 20 for i in range(60)]
    for limit, few in ((1 << 30, False), (2_000, False), (1 << 30, True)):
        monkeypatch.setattr(pieces, "CACHE_BYTES", limit)
        hashes = pieces.part_hashes
        if few:  # all hashes alike but for two bits
            monkeypatch.setattr(pieces, "part_hashes", lambda *a: hashes(*a) & np.uint64(3))
        held = pieces.PartIds(lambda parts: [reference.encode_ordinary(p) for p in parts])
        for low in range(0, 60, 7):
            some = [t.encode() for t in texts[low : low + 7]]
            raw, offsets = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
            found = {}
            for row, ids, _ in pieces.token_runs(raw, offsets, held):
                found.setdefault(row, []).extend(ids.tolist())
            assert [found[k] for k in range(len(some))] == [reference.encode_ordinary(t.decode()) for t in some]
        assert held.held_bytes < limit + 40_000
