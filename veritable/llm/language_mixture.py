"""Language identification by mixtures of n-gram models.

Training counts the letter trigrams of every labelled text into a fixed number of hash buckets
for each language. A document is seen as a mixture: expectation-maximisation estimates the share
of each language in its trigrams. Languages with little share leave the set; then the least one
leaves for as long as the likelihood, less a penalty for each language kept, does not fall. The
prediction is the language of the largest share in the set that is left.

A document is identified if the set that is left explains it: each trigram belongs to the set's
mixture or to a background in which all buckets are equally likely, and the part that belongs to
the mixture counts, whatever the number of languages in it.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text
if nothing could be learned. Repeated rows are predicted each. An empty table gives no rows.
Ties go to the language that sorts first. Training ignores rows without a label or a text.
Other columns are ignored by `predict` and passed through by `filter_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.shared import slices

BUCKETS = 1 << 15
SMOOTHING = 0.2
ROUNDS = 8
LEAST_SHARE = 0.05
PENALTY = 4.0
MIN_EXPLAINED = 0.4
UNKNOWN = "und"
_DOCS = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_counts(texts: list[str | None], space: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the letter trigrams of each text, in order of text.

    Letters are lower-cased, all else between them counts as one blank; a trigram is any three
    neighbours with a letter in the middle. Buckets are a power of two, `space`.
    """
    lowered = [t.lower() if t else "" for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[codes]
    border = np.zeros(len(codes), bool)
    begins = np.cumsum(sizes) - sizes
    border[begins[sizes > 0]] = True
    codes = np.where(letter, codes, 0).astype(np.uint64)
    before = np.r_[np.zeros(1, np.uint64), codes[:-1]] if len(codes) else codes
    before = np.where(border, np.uint64(0), before)
    after = np.r_[codes[1:], np.zeros(1, np.uint64)] if len(codes) else codes
    ends = np.r_[border[1:], True] if len(codes) else border
    after = np.where(ends, np.uint64(0), after)
    h = before[letter] * np.uint64(0x9E3779B97F4A7C15) + codes[letter] * np.uint64(0xC2B2AE3D27D4EB4F) + after[letter] * np.uint64(0x165667B19E3779F9)
    bucket = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - space.bit_length())).astype(np.int64)
    owner = owner[letter]
    rows, buckets, counts = [], [], []
    for low in range(0, len(texts), _DOCS):
        a, b = np.searchsorted(owner, [low, low + _DOCS])
        if a == b:
            continue
        table = np.bincount((owner[a:b] - low) * space + bucket[a:b], minlength=0)
        at = np.flatnonzero(table)
        rows.append(at // space + low)
        buckets.append(at % space)
        counts.append(table[at])
    if not rows:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(counts)


@dataclass(frozen=True)
class Model:
    """Languages in order, and the probability of each bucket in each (buckets by languages)."""

    languages: list[str]
    chance: np.ndarray


def train(labelled: DataFrame, label: str = "lang", text: str = "text", buckets: int = BUCKETS) -> Model:
    """Count every labelled text; the driver gets one number for each language and bucket at most.

    `buckets` is a power of two.
    """
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t"):
            labels = np.array(batch.column("l").to_pylist(), object)
            row, bucket, count = trigram_counts(batch.column("t").to_pylist(), buckets)
            for name in set(labels):
                mine = labels[row] == name
                tables.setdefault(name, np.zeros(buckets, np.int64))
                tables[name] += np.bincount(bucket[mine], weights=count[mine], minlength=buckets).astype(np.int64)
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at])], names=["l", "b", "n"])

    rows = labelled.select(F.col(label).alias("l"), F.col(text).alias("t")).filter("l is not null and t is not null")
    counts = rows.mapInArrow(run, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("l").to_pylist()))
    table = np.zeros((buckets, len(names)))
    if names:
        column = np.searchsorted(names, counts.column("l").to_pylist())
        table[counts.column("b").to_numpy(), column] = counts.column("n").to_numpy()
    table += SMOOTHING
    return Model(names, (table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def _shares(chance: np.ndarray, count: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each document by EM, and the log-likelihood they give."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        weighed = chance * np.repeat(share, sizes, axis=0).astype(np.float32)
        weighed *= (count / weighed.sum(axis=1))[:, None].astype(np.float32)
        share = np.add.reduceat(weighed, starts, axis=0, dtype=np.float64) / total[:, None]
    mixed = (chance * np.repeat(share, sizes, axis=0).astype(np.float32)).sum(axis=1)
    return share, np.add.reduceat(count * np.log(mixed, dtype=np.float64), starts)


def mixtures(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the shares of all languages, and of those its selected set holds; zero without letters."""
    return _mixtures(model, texts)[:2]


def _mixtures(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `mixtures`, and the part of each text's trigrams that its selected set explains."""
    full = np.zeros((len(texts), len(model.languages)))
    selected, explained = full.copy(), np.zeros(len(texts))
    row, bucket, count = trigram_counts(texts, len(model.chance))
    if not len(row) or not model.languages:
        return full, selected, explained
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    docs = row[starts]
    chance, count = model.chance[bucket], count.astype(np.float64)
    share, _ = _shares(chance, count, starts, sizes, np.ones((len(docs), len(model.languages))), ROUNDS)
    full[docs] = share
    allowed = (share >= LEAST_SHARE) | (share == share.max(axis=1, keepdims=True))
    best = np.zeros_like(share)
    fit = np.full(len(docs), -np.inf)
    work = np.arange(len(docs))
    while len(work):
        entries = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in work])
        own = sizes[work]
        at = np.cumsum(own) - own
        got, likely = _shares(chance[entries], count[entries], at, own, allowed[work].astype(float), ROUNDS)
        likely = likely - PENALTY * np.log(np.add.reduceat(count[entries], at) + 1) * allowed[work].sum(axis=1)
        better = likely >= fit[work]
        work, got = work[better], got[better]
        fit[work], best[work] = likely[better], got
        more = allowed[work].sum(axis=1) > 1
        work, got = work[more], got[more]
        if len(work):
            least = np.where(allowed[work], got, np.inf).argmin(axis=1)
            allowed[work, least] = False
    selected[docs] = best
    mixed = (chance * np.repeat(best, sizes, axis=0).astype(np.float32)).sum(axis=1, dtype=np.float64)
    explained[docs] = np.add.reduceat(count * mixed / (mixed + 1 / len(model.chance)), starts) / np.add.reduceat(count, starts)
    return full, selected, explained


def identify(docs: DataFrame, model: Model, text: str = "text", prediction: str = "lang_pred", score: str = "score", mixture: str = "mixture", explained: str = "explained") -> DataFrame:
    """The rows with the predicted language, the share it has among all languages, the selected set, and the part it explains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            full, selected, part = _mixtures(model, batch.column(place).to_pylist())
            top = selected.argmax(axis=1) if model.languages else np.zeros(batch.num_rows, int)
            known = selected.any(axis=1)
            said = [model.languages[k] if ok else UNKNOWN for k, ok in zip(top, known)]
            sure = [float(full[n, k]) if ok else 0.0 for n, (k, ok) in enumerate(zip(top, known))]
            sets = [",".join(f"{model.languages[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) for row in selected]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(sets, pa.string()), pa.array(part)],
                names=[*names, prediction, score, mixture, explained])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{prediction} string, {score} double, {mixture} string, {explained} double"])
    return docs.mapInArrow(run, schema)


def held_out(id_column: str) -> Column:
    """Documents that training does not see: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, and predict all of them."""
    model = train(docs.filter(F.col(id_column).isNotNull() & ~held_out(id_column)), label, text)
    rows = docs.select(F.col(id_column).alias("doc"), held_out(id_column).alias("held_out"), F.col(text).alias("t"))
    out = identify(rows, model, "t")
    return out.select(F.col("doc").alias(id_column), "held_out", "lang_pred", "score", "mixture")


def filter_identified(docs: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id", min_explained: float = MIN_EXPLAINED) -> DataFrame:
    """The documents of which the selected languages, one or several, explain at least `min_explained`."""
    model = train(docs.filter(F.col(f"`{id_column}`").isNotNull() & ~held_out(id_column)), label, text)
    out = identify(docs, model, text, "__lang", "__share", "__set", "__explained")
    return out.filter((F.col("__lang") != UNKNOWN) & (F.col("__explained") >= min_explained)).drop("__lang", "__share", "__set", "__explained")
