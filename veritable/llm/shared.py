"""What several operators need: tables in the shared folder, and words of Arrow batches as numpy arrays.

Words and pieces of text are never made into Python strings one by one. A batch's UTF-8 bytes
are one array; words are spans of it, which are hashed eight bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veritable.session import scratch_path

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False

#: Spans up to this length are hashed eight bytes at a time, all spans at once; longer ones one by one.
SHORT_SPAN = 64
EIGHT_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about SLICE_BYTES of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no row boundary cuts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    first[cuts] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(inside), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    return starts, np.flatnonzero(last & inside) + 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: byte starts, byte ends, and for each row its first word (with the total last)."""
    starts, ends = spans(IS_WORD[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number; the data has eight bytes to spare."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def spared(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Each step mixes all bits before the next eight bytes come in, so no pattern of bytes cancels out.
    """
    numbers, sizes = eights(spared(raw)), ends - starts
    out = mix(sizes.astype(np.uint64))
    at, done = np.flatnonzero(sizes <= SHORT_SPAN), 0
    while len(at):
        left = sizes[at] - done
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + (numbers[starts[at] + done] & EIGHT_MASKS[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for k in np.flatnonzero(sizes > SHORT_SPAN).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
