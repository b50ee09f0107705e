"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document's ids and an end id are cut into full sequences and a rest. The rests are dealt over
shards by hash, so each shard holds a bounded number of them however large the corpus is. In a
shard, with as many sequences as its tokens need, rests go in descending length to the sequence
of the lowest estimated cost (linear plus quadratic in each piece's length) that has room; a
rest that fits nowhere whole is cut at the sequence with the most room. Only a shard's last few
sequences can have padding, less than one sequence in all.

Defined cases: a null text counts as empty and is the end id alone. A text that spells an added
token out has that token's id there, as the tokenizer gives it. Repeated rows, also with
the same id, are packed each on its own. An empty table gives no rows. Other columns are
ignored. Ties in length go by the row's place in the input, ties in cost to the lower sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.pieces import PartIds, token_runs
from veritable.llm.shared import slices, stored, text_bytes

SEQUENCE = 1024
END_ID = 0
#: Sequences of a shard, and the cost of a piece of n tokens: n + ATTENTION * n * n.
SHARD_SEQUENCES = 256
ATTENTION = 1 / 2048


@lru_cache(maxsize=2)
def _encoder(path: str) -> PartIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("an added token that takes in blanks, or asks for a word of its own, cannot be cut from the text")
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return PartIds(lambda parts: [x.ids for x in batch(parts, add_special_tokens=False)], [t.content for t in added])


def cut_documents(docs: DataFrame, vocabulary: str, id_column: str, text: str, length: int = SEQUENCE) -> DataFrame:
    """Per document: a row number, token count, checksums of its full sequences, and the ids of its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base, row_no, full_no = _encoder(vocabulary), TaskContext.get().partitionId() << 36, 0, 0
        for batch in slices(batches, "t"):
            raw, offsets = text_bytes(batch.column("t"))
            out: list[tuple] = []
            held, total, sums = np.zeros(0, "<u4"), 0, []
            for _, ids, last in token_runs(raw, offsets, parts):
                held = np.concatenate([held, ids.astype("<u4"), np.full(int(last), END_ID, "<u4")])
                total += len(ids) + int(last)
                full = len(held) // length
                sums += [zlib.crc32(held[k * length : (k + 1) * length].tobytes()) for k in range(full)]
                held = held[full * length :]
                if last:
                    out.append((base + row_no, total, sums, base + full_no, held.tobytes()))
                    row_no, full_no = row_no + 1, full_no + len(sums)
                    held, total, sums = np.zeros(0, "<u4"), 0, []
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([
                batch.column("i"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()),
            ], names=["i", "row", "doc_tokens", "sums", "first_full", "rest"])

    rows = docs.select(F.col(id_column).alias("i"), F.col(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, row long, doc_tokens long, sums array<long>, first_full long, rest binary")


def fill(lengths: list[int], length: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(rest, start in it, tokens, sequence, offset) of each piece; the lengths come in descending order."""
    count = -(-sum(lengths) // length)
    room = np.full(count, length, np.int64)
    cost = np.zeros(count)
    out = []
    for k, size in enumerate(lengths):
        start = 0
        while size:
            fits = np.flatnonzero(room >= size)
            at = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
            take = min(size, int(room[at]))
            out.append((k, start, take, at, length - int(room[at])))
            room[at] -= take
            cost[at] += take + ATTENTION * take * take
            start, size = start + take, size - take
    return out


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", length: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """One row per piece: document, start, length, checksum of its ids, sequence and offset there."""
    cut = stored(cut_documents(docs, vocabulary, id_column, text, length), "packing-cut")
    kind = cut.schema["i"].dataType.simpleString()
    full = cut.select("i", "doc_tokens", "first_full", F.posexplode("sums").alias("k", "ids_crc32")).select(
        "i", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.lit(1 << 62) + F.col("first_full") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    size = F.octet_length("rest") / 4
    rests = cut.filter(F.octet_length("rest") > 0)
    total = rests.agg(F.sum(size)).first()[0] or 0
    shards = max(1, int(total // (length * shard_sequences)))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rest = [np.frombuffer(x, "<u4") for x in group["rest"]]
        order = sorted(range(len(rest)), key=lambda k: (-len(rest[k]), group["row"].iat[k]))
        rows = [
            (order[k], start, take, zlib.crc32(rest[order[k]][start : start + take].tobytes()), (key[0] << 20) + at, offset)
            for k, start, take, at, offset in fill([len(rest[k]) for k in order], length)
        ]
        out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "sequence_id", "offset"])
        of = group.iloc[out["k"]].reset_index(drop=True)
        out["start"] += of["doc_tokens"] - np.array([len(x) for x in rest])[out["k"]]
        return pd.concat([of[["i"]], out[["start", "length", "ids_crc32"]], of[["doc_tokens"]], out[["sequence_id", "offset"]]], axis=1)

    placed = rests.select("i", "row", "doc_tokens", "rest", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard")).groupBy("shard").applyInPandas(
        place, f"i {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(placed).withColumnRenamed("i", id_column)
