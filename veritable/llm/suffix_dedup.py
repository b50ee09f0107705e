"""Removal of repeated passages by a sparse suffix array.

A passage is a run of at least `min_words` words; of each passage that occurs again, the first
occurrence (by document id, text digest and place) stays and later ones are removed. Exactly: a
word goes if it lies in a window of `min_words` words that also starts at an earlier place.

1. Sampling: each window selects the least hash among its runs of ANCHOR_WORDS words, so equal
   windows select the same place in them. Only these suffixes are retained, each with the
   windows that selected it; what those windows cover is the suffix's passage.
2. Sorting: suffixes are sorted by anchor and passage over ranges of all sort columns, so that
   no key is hot, and neighbours are compared. Suffixes of one anchor and one passage are
   occurrences of all its windows; all but the first are removed whole.
3. Extension: where one anchor has several passages, the first suffix of each is extended left
   and right over its own windows, which are sorted and compared with their neighbours again.
   Comparing whole windows instead of the longest match to one neighbour loses no repeat: the
   neighbour that matches furthest to the right need not be the one that matches to the left.

Groups that a batch of sorted rows cuts are put together again by their key afterwards; that
concerns two groups a batch.

Words are white-space separated. Runs of words are compared by 128 bits: two independent hashes,
doubled from words to runs of 2, 4, 8, ... words with all bits mixed at each step. Defined cases: a
null or empty text has no words and keeps what it has; texts shorter than a window are never
changed. Rows that repeat with the same id and text count as one document and get one result
each, the same. Occurrences that overlap each other in one text count. An empty table gives no
rows. Other columns are passed through by `remove_repeats` and ignored by `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.quality_rules import word_array
from veritable.llm.shared import mix, slices, span_hashes, stored, text_bytes, word_spans

MIN_WORDS = 50
ANCHOR_WORDS = 8
_STEPS = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]], np.uint64)


class _Words:
    """Word hashes of a slice, and hashes of runs of words by doubling: runs of 2, 4, 8, ... words."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = text_bytes(column)
        starts, ends, self.first = word_spans(raw, offsets)
        self.hashes = span_hashes(raw, starts, ends)
        self.doubled = [[mix(self.hashes * step[1])] for step in _STEPS]

    def _of(self, half: int, level: int) -> np.ndarray:
        """Hashes of all runs of 2 ** level words."""
        levels = self.doubled[half]
        while len(levels) <= level:
            last, gap = levels[-1], 1 << (len(levels) - 1)
            levels.append(mix(last[: len(last) - gap] * _STEPS[half, 0] + last[gap:]) if len(last) > gap else last[:0])
        return levels[level]

    def runs(self, a: np.ndarray, b: np.ndarray, half: int = 0) -> np.ndarray:
        """One of two independent hashes of the words a to b - 1: of the two powers of two that cover them."""
        sizes = b - a
        level = np.frexp(sizes.astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            one = self._of(half, k)
            out[at] = mix(one[a[at]] * _STEPS[half, 1] + mix(one[b[at] - (1 << k)] + sizes[at].astype(np.uint64)))
        return out


def _unseen(batch: pa.RecordBatch, seen: set) -> np.ndarray:
    """Which rows are the first of their id and text in this task."""
    new = np.ones(batch.num_rows, bool)
    for k, key in enumerate(zip(batch.column("i").to_pylist(), batch.column("tid").to_pylist())):
        new[k] = key not in seen
        seen.add(key)
    return new


def _suffixes(min_words: int, anchor: int):
    """Sampled suffixes of each text: anchor, passage, and the first and last window."""
    reach = min_words - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches, "t"):
            ids, texts = batch.column("i"), batch.column("tid")
            words = _Words(batch.column("t"))
            n = len(words.hashes)
            if n < min_words:
                continue
            at = np.arange(n - anchor + 1)
            anchors = words.runs(at, at + anchor)
            windows = np.arange(n - min_words + 1)
            chosen = windows + np.lib.stride_tricks.sliding_window_view(anchors, reach).argmin(axis=1)
            row = np.searchsorted(words.first, windows, "right") - 1
            new = _unseen(batch, seen)
            valid = (windows + min_words <= words.first[row + 1]) & new[row]
            windows, chosen, row = windows[valid], chosen[valid], row[valid]
            if not len(windows):
                continue
            change = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
            low, high = windows[change], windows[np.r_[change[1:], len(windows)] - 1]
            place, row = chosen[change], row[change]
            passage = mix(words.runs(low, high + min_words, 1) + (place - low).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchors[place].view(np.int64)), pa.array(passage.view(np.int64)), ids.take(pa.array(row)), texts.take(pa.array(row)),
                pa.array((low - words.first[row]).astype(np.int64)), pa.array((high - words.first[row]).astype(np.int64)),
            ], names=["anchor", "passage", "i", "tid", "low", "high"])

    return run


def _same_as_before(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows repeat the one before them: the same suffix of a repeated document."""
    out = np.zeros(batch.num_rows, bool)
    same = np.ones(batch.num_rows - 1, bool)
    for name in ("anchor", "passage", "i", "tid", "low"):
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same &= equal.to_numpy(zero_copy_only=False)
    out[1:] = same
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes: those equal to the one before (again), and the first of each passage
    whose anchor has other passages or may go on in another batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        passage = batch.column("passage").to_numpy()
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        first = new_anchor | np.r_[True, passage[1:] != passage[:-1]]
        run = np.cumsum(new_anchor) - 1
        passages = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_anchor))[run]
        cut = (run == 0) | (run == run[-1])
        keep = (~first | (passages > 1) | cut) & ~_same_as_before(batch)
        part = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(~first[keep])], names=[*part.schema.names, "again"])


def _compared(sampled: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(suffixes that occur earlier too, first suffixes of their passage that may need extension)."""
    order = ["anchor", "passage", "i", "tid", "low"]
    parts = int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sampled.schema)
    near = stored(sampled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"{kind}, again boolean"), name)
    heads = near.filter("not again")
    named = F.struct("i", "tid", "low", "high")
    least = heads.groupBy("anchor", "passage").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    later = heads.join(least.filter("n > 1"), ["anchor", "passage"]).filter(~named.eqNullSafe(F.col("first")))
    again = near.filter("again").select("i", "tid", "low", "high").unionByName(later.select("i", "tid", "low", "high"))
    mixed = least.groupBy("anchor").agg(F.min("passage").alias("a"), F.max("passage").alias("b")).filter("a <> b").select("anchor")
    return again, least.join(mixed, "anchor").select("first.*")


def _windows(min_words: int):
    """The windows of the listed suffixes, each as a suffix of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches, "t"):
            new = _unseen(batch, seen)
            if not new.any():
                continue
            batch = batch.filter(pa.array(new))
            words = _Words(batch.column("t"))
            lists = batch.column("runs").to_pylist()
            rows, starts = [], []
            for k, runs in enumerate(lists):
                for one in {(r["low"], r["high"]) for r in runs}:
                    part = np.arange(one[0], one[1] + 1)
                    rows.append(np.full(len(part), k))
                    starts.append(part)
            row, start = np.concatenate(rows), np.concatenate(starts)
            at = words.first[row] + start
            found, rest = words.runs(at, at + min_words), words.runs(at, at + min_words, 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(found.view(np.int64)), pa.array(rest.view(np.int64)), batch.column("i").take(pa.array(row)),
                batch.column("tid").take(pa.array(row)), pa.array(start), pa.array(start),
            ], names=["anchor", "passage", "i", "tid", "low", "high"])

    return run


def _named(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").alias("i"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("tid"), F.col(f"`{text}`").alias("t"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Per id and text digest the merged spans of words to remove, as [start, end) structs."""
    rows = _named(docs, id_column, text)
    kind = f"anchor long, passage long, i {rows.schema['i'].dataType.simpleString()}, tid binary, low long, high long"
    sampled = stored(rows.mapInArrow(_suffixes(min_words, anchor_words), kind), "suffix-sample")
    again, mixed = _compared(sampled, "suffix-neighbours")
    runs = mixed.groupBy(F.col("i").alias("j"), F.col("tid").alias("digest")).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    with_text = rows.join(runs, (F.col("tid") == F.col("digest")) & F.col("i").eqNullSafe(F.col("j"))).select("i", "tid", "t", "runs")
    windows = with_text.mapInArrow(_windows(min_words), kind)
    again_too, _ = _compared(stored(windows, "suffix-windows"), "suffix-window-neighbours")
    covered = again.unionByName(again_too).select("i", "tid", "low", (F.col("high") + min_words).alias("end"))
    spans = F.array_sort(F.collect_set(F.struct("low", "end")))
    return covered.groupBy("i", "tid").agg(spans.alias("spans")).mapInPandas(_merged, f"i {rows.schema['i'].dataType.simpleString()}, tid binary, spans array<struct<low:long,end:long>>")


def _merged(frames: Iterator) -> Iterator:
    """Overlapping spans of each text joined."""
    for frame in frames:
        out = []
        for spans in frame["spans"]:
            joined: list[dict] = []
            for span in spans:
                if joined and span["low"] <= joined[-1]["end"]:
                    joined[-1]["end"] = max(joined[-1]["end"], span["end"])
                else:
                    joined.append({"low": span["low"], "end": span["end"]})
            out.append(joined)
        frame["spans"] = out
        yield frame


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    found = spans.select(F.col("i").alias("__i"), F.col("tid").alias("__digest"), F.col("spans").alias("__spans"))
    return rows.join(found, (F.col("__tid") == F.col("__digest")) & F.col("__id").eqNullSafe(F.col("__i")), "left")


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: its words, how many go, and the spans that go."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), F.unhex(F.md5(value)).alias("__tid"), F.size(word_array(value)).cast("long").alias("n_words"))
    empty = F.array().cast("array<struct<low:long,end:long>>")
    joined = _with_spans(rows, repeated_spans(docs, id_column, text, min_words)).withColumn("spans", F.coalesce("__spans", empty))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["low"])
    return joined.select(F.col("__id").alias(id_column), "n_words", gone.alias("n_removed"), "spans")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, chars: str = "n_chars") -> DataFrame:
    """The documents without their repeated passages; one that had words and has none left goes.

    A column of the name `chars` gets the new number of characters.
    """
    spans = repeated_spans(docs, id_column, text, min_words)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumns({"__id": F.col(f"`{id_column}`"), "__tid": F.unhex(F.md5(value))})
    joined = _with_spans(rows, spans).drop("__id", "__tid", "__i", "__digest")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.names.index(text)
            raw, offsets = text_bytes(batch.column(at))
            starts, _, first = word_spans(raw, offsets)
            old, out, keep = batch.column(at).to_pylist(), [], []
            for k, spans_of in enumerate(batch.column("__spans").to_pylist()):
                if not spans_of:
                    out.append(old[k])
                    keep.append(True)
                    continue
                begin, end = int(offsets[k]), int(offsets[k + 1])
                cuts = np.append(starts[first[k] : first[k + 1]], end)
                pieces, here = [], begin
                for span in spans_of:
                    pieces.append(raw[here : cuts[span["low"]]].tobytes())
                    here = int(cuts[span["end"]])
                left = b"".join([*pieces, raw[here:end].tobytes()]).decode()
                out.append(left)
                keep.append(sum(s["end"] - s["low"] for s in spans_of) < len(cuts) - 1)
            columns = [pa.array(out, pa.string()) if n == text else batch.column(batch.schema.names.index(n)) for n in names]
            if chars in names:
                sizes = pa.array([None if x is None else len(x) for x in out], batch.schema.field(chars).type)
                columns[names.index(chars)] = sizes
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
