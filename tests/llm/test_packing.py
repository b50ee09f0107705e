import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import TABLES
from veritable.llm import packing as P
from odd_rows import odd_docs  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(tokenizer, docs, **sizes):
    rows = P.pack(docs, PATH, **sizes).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r.doc_id, len(ids))] += 1
        texts[r.doc_id] = ids
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = texts[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        covered[(r.doc_id, r.doc_tokens)] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(list(range(k[1])) * n) for k, n in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= P.SEQUENCE
    return sequences


texts: dict = {}


def test_every_id_is_in_one_piece(spark, tokenizer):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    sequences = check(tokenizer, docs, shard_sequences=16)
    total = sum(n for pieces in sequences.values() for _, n in pieces)
    assert len(sequences) * P.SEQUENCE - total <= P.SEQUENCE * max(1, total // (P.SEQUENCE * 16))


def test_odd_rows(odd_docs, tokenizer):
    check(tokenizer, odd_docs)
    assert P.pack(odd_docs.limit(0), PATH).collect() == []


def test_costs_are_balanced():
    pick = np.random.default_rng(3)
    lengths = sorted(pick.integers(1, 1024, 400).tolist(), reverse=True)
    cost = collections.Counter()
    for _, _, size, at, _ in P.fill(lengths):
        cost[at] += size + P.ATTENTION * size * size
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.2 and len(cost) == -(-sum(lengths) // P.SEQUENCE)


def test_added_tokens_in_a_text(spark, tokenizer):
    end = "<|endoftext|>"
    cases = [
        f"end {end} next", f"end   {end}   next", f"a{end}b", f"{end}", f"{end} {end}  {end}{end}", f"  {end}\n {end} \n x", f"x \u00a0 {end} \u00a0 y",
        f" {end} word {end} " * 300, "cut <|endof", "text|> here", f"< {end}> <|endoftext |>", " ", f"tail {end} ",
    ]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").coalesce(1)
    assert tokenizer.encode(cases[0], add_special_tokens=False).ids == [437, 220, 50256, 1306]
    check(tokenizer, docs)
