"""Byte-level BPE encoding and decoding on padded numpy matrices.

The distinct pieces of a batch are bucketed by length into padded matrices of token ids. Each
round every row merges its leftmost pair of minimum rank, found by hashed lookup of pairs;
every merge shortens its row by one, so the matrix loses a column a round, and rows without a
pair that merges are taken out. Pieces beyond LONG_PIECE bytes, for which a round per merge
would cost the square of their length, follow the same rule with a heap.

Defined cases: a null text counts as empty and has no ids. Texts of any length are worked
through in runs of parts, never cut. Repeated rows give repeated rows; an empty table gives
none. Other columns are ignored. The rank file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.pieces import PartIds, token_runs
from veritable.llm.shared import gathered, slices, text_bytes

LONG_PIECE = 256
BUCKET_ROWS = 1 << 14
_NONE = np.int32(2**31 - 1)
_SLOT = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Ranks of token strings, and of all pairs whose strings join to one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_rank = np.full(1 << bits, _NONE)
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = ((keys * _SLOT) >> self.shift).astype(np.int64)
        while len(keys):
            free = self.slot_key[slots] == np.uint64(2**64 - 1)
            _, first = np.unique(slots, return_index=True)
            mine = np.zeros(len(keys), bool)
            mine[first] = True
            mine &= free
            self.slot_key[slots[mine]], self.slot_rank[slots[mine]] = keys[mine], values[mine]
            keys, values, slots = keys[~mine], values[~mine], (slots[~mine] + 1) & self.mask
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        size = by_rank[-1][1] + 1 if by_rank else 0
        lengths = np.zeros(size, np.int64)
        lengths[[r for _, r in by_rank]] = [len(t) for t, _ in by_rank]
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.token_length = lengths
        self.token_start = np.cumsum(lengths) - lengths

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; ids below 0 are padding."""
        out = np.full(left.shape, _NONE)
        real = (left >= 0) & (right >= 0)
        keys = (left[real].astype(np.uint64) << np.uint64(32)) | right[real].astype(np.uint64)
        slots = ((keys * _SLOT) >> self.shift).astype(np.int64)
        found = np.full(len(keys), _NONE)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slots[open_]
            here = self.slot_key[at]
            hit = here == keys[open_]
            found[open_[hit]] = self.slot_rank[at[hit]]
            open_ = open_[~hit & (here != np.uint64(2**64 - 1))]
            slots[open_] = (slots[open_] + 1) & self.mask
        out[real] = found
        return out

    def merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Merge each row of a padded matrix as far as it goes."""
        done: list[np.ndarray] = [rows[:0]] * len(rows)
        which = np.arange(len(rows))
        ranks = self.rank_of(rows[:, :-1], rows[:, 1:])
        while len(which):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), _NONE)
            over = low == _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    done[which[i]] = rows[i, : lengths[i]].copy()
                go = ~over
                rows, ranks, lengths, which, best, low = rows[go], ranks[go], lengths[go], which[go], best[go], low[go]
                if not len(which):
                    break
            n, width = rows.shape
            every = np.arange(n)
            rows[every, best] = low
            columns = np.arange(width - 1)
            rows = np.take_along_axis(rows, columns + (columns > best[:, None]), axis=1)
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), axis=1)
            lengths = lengths - 1
            left = best > 0
            if left.any():
                i, j = every[left], best[left]
                ranks[i, j - 1] = self.rank_of(rows[i, j - 1], rows[i, j])
            right = best < width - 2
            if right.any():
                i, j = every[right], best[right]
                ranks[i, j] = self.rank_of(rows[i, j], rows[i, j + 1])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """The same rule for one long piece, with a heap of (rank, place)."""
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids):
                rank = self.pairs.get((ids[i] << 32) | ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONG_PIECE:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            for low in range(0, len(members), BUCKET_ROWS):
                part = members[low : low + BUCKET_ROWS]
                lengths = np.array([len(pieces[i]) for i in part])
                rows = np.full((len(part), int(lengths.max())), -1, np.int32)
                inside = np.arange(rows.shape[1]) < lengths[:, None]
                rows[inside] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, ids in zip(part, self.merge_rows(rows, lengths)):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return self.token_bytes[gathered(self.token_start[ids], self.token_length[ids])]


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, as the tokenizer's own engine reads it."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[MergeTable, PartIds]:
    """One encoder a worker process."""
    with open(path, "rb") as lines:
        table = MergeTable({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
    split = split_pattern(pattern)

    def encode(parts: list[str]) -> list:
        found = [split.findall(part) for part in parts]
        unique = {piece: k for k, piece in enumerate(dict.fromkeys(p for pieces in found for p in pieces))}
        ids = table.encode_pieces([piece.encode() for piece in unique])
        return [ids[unique[p[0]]] if len(p) == 1 else [x for piece in p for x in ids[unique[piece]]] for p in found]

    return table, PartIds(encode)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, the SHA-256 of its ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts = _encoder(rank_file, pattern)
        for batch in slices(batches, "t"):
            raw, offsets = text_bytes(batch.column("t"))
            counts, of_ids, of_bytes = [], [], []
            total, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
            for _, ids, last in token_runs(raw, offsets, parts):
                total += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                bytes_hash.update(table.decode(ids).tobytes())
                if last:
                    counts.append(total)
                    of_ids.append(ids_hash.hexdigest())
                    of_bytes.append(bytes_hash.hexdigest())
                    total, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["i", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).alias("i"), F.col(text).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("i", id_column)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with a column of token ids, an array of int, in place of the text."""
    kept = [name for name in docs.columns if name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts = _encoder(rank_file, pattern)
        for batch in slices(batches, text):
            raw, offsets = text_bytes(batch.column(batch.schema.names.index(text)))
            rows: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for row, found, _ in token_runs(raw, offsets, parts):
                rows[row].append(found)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in rows]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + [lists], names=[*kept, ids])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + [f"`{ids}` array<int>"])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the bytes that their ids decode to, in place of the ids; null ids decode to nothing."""
    kept = [name for name in tokens.columns if name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _encoder(rank_file, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            out = [table.decode(np.array(x or [], np.int64)).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + [pa.array(out, pa.binary())], names=[*kept, text])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != ids] + [f"`{text}` binary"])
    return tokens.mapInArrow(run, schema)
