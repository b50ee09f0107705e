"""Exact top-k search by inner product: global score histograms locate each query's k-th score.

Candidates and queries are packed into blocks of a fixed number of rows, and every query block
meets every candidate block through a join on a slot number, so no side is broadcast and no key
is hot. Each round scores all pairs of blocks; a block reports, for each query, the counts of
the highest bins down to its own k-th best, which is all that can matter globally. The summed
histogram gives the bin of the k-th score, the next round splits that bin, until bins hold one
score. A last pass keeps scores at or above it; ties go to the smaller id.

Defined cases: vectors that are null, or hold null, NaN or an infinity, take no part; nor do
rows without an id. Vectors of different lengths do not meet. A row with the query's id is the
query's own. Queries that repeat with equal vectors count once. Fewer than k candidates give
fewer rows; empty tables give none. Products are exact: beyond 2^53 they are computed with
whole numbers, and a score that does not fit a long fails the job. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.shared import stored

SCALE = 1024
BLOCK_ROWS = 2048
QUERY_ROWS = 256
BINS = 4096
_SAFE = float(1 << 52)


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Usable vectors as longs: floor(scale * x) of each component."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
    )


def _packed(rows: int):
    """Rows of equal dimension as blocks: ids and vectors as bytes, and a number within the partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            got = held.pop(dim)
            number += 1
            ids = np.array([x[0] for x in got], np.int64).tobytes()
            values = np.concatenate([x[1] for x in got]).astype(np.int64).tobytes() if dim else b""
            extra = b"".join(x[2] for x in got)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "number": pa.array([(part << 32) + number], pa.int64()),
                "ids": pa.array([ids], pa.binary()), "vectors": pa.array([values], pa.binary()), "extra": pa.array([extra], pa.binary()),
            })

        for batch in batches:
            table = batch.to_pydict()
            extra = table.get("state", [b""] * batch.num_rows)
            for key, vector, state in zip(table["id"], table["v"], extra):
                dim = len(vector)
                held.setdefault(dim, []).append((key, np.array(vector, np.int64), state))
                if len(held[dim]) == rows:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return pack


_BLOCK = "dim int, number long, ids binary, vectors binary, extra binary"


def _products(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and the scores of all their pairs, own rows marked as missing.

    Scores are float64 where all are exact in it, else Python whole numbers.
    """
    dim = row["dim"]
    qid, cid = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(qid), dim)
    c = np.frombuffer(row["vectors"], np.int64).reshape(len(cid), dim)
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(dim, 1)
    if top < _SAFE:
        scores = q.astype(np.float64) @ c.T.astype(np.float64)
    else:
        scores = q.astype(object) @ c.T.astype(object)
    return qid, cid, scores


def _histograms(k: int):
    """For each query the counts of its top bins in this pair of blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, cid, scores = _products(row)
                state = np.frombuffer(row["q_extra"], np.int64).reshape(len(qid), 4)
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(qid)):
                    query, low, high, need = state[i].tolist()
                    width = -(-(high - low) // BINS)
                    inside = (cid != qid[i]) & (scores[i] >= low) & (scores[i] < high)
                    if not inside.any():
                        continue
                    bins = ((scores[i][inside] - low) // width).astype(np.int64)
                    if len(bins) > need:
                        bins = bins[bins >= np.partition(bins, len(bins) - need)[len(bins) - need]]
                    values, counts = np.unique(bins, return_counts=True)
                    out.append((np.full(len(values), query), values, counts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["query", "bin", "n"])

    return count


def _at_least(k: int):
    """The pairs at or above each query's k-th score, at most k of a block for each query."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, cid, scores = _products(row)
                state = np.frombuffer(row["q_extra"], np.int64).reshape(len(qid), 4)
                out = []
                for i in range(len(qid)):
                    hit = np.flatnonzero((cid != qid[i]) & (scores[i] >= state[i, 1]))
                    values = scores[i][hit]
                    best = np.lexsort((cid[hit], -values))[:k]
                    out.append((np.full(len(best), state[i, 0]), np.full(len(best), qid[i]), cid[hit][best], np.array([int(x) for x in values[best]], np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["query", "query_id", "vec_id", "score"])

    return select


def _meet(candidates: DataFrame, queries: DataFrame, slots: int) -> DataFrame:
    """Every query block beside every candidate block."""
    spread = queries.select(
        F.col("dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("extra").alias("q_extra"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    placed = candidates.withColumn("slot", F.pmod(F.xxhash64("number"), F.lit(slots)).cast("int"))
    return placed.join(spread.hint("shuffle_merge"), ["slot", "dim"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; both inputs hold `id` and `v`."""
    spark = candidates.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    blocks = stored(candidates.mapInArrow(_packed(block_rows), _BLOCK), "topk-blocks")
    norm: Column = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    most = candidates.agg(F.max(norm)).first()[0]
    reach = F.ceil(norm * F.lit(float(most or 0.0)) * 1.000001 + 2).cast("long")
    named = queries.distinct().withColumn("query", F.xxhash64("id", "v"))
    state = stored(named.select(
        "id", "v", "query", (-reach).alias("low"), (reach + 1).alias("high"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("found"),
    ), "topk-state")
    width = F.expr(f"(high - low + {BINS - 1}) div {BINS}")
    while not (open_ := state.filter("not found")).isEmpty():
        counts = _meet(blocks, _query_blocks(open_, query_rows), slots).mapInArrow(_histograms(k), "query long, bin long, n long")
        summed = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query").orderBy(F.desc("bin"))
        ranked = summed.withColumn("upto", F.sum("n").over(above)).join(open_.select("query", "need"), "query")
        kth = ranked.filter(F.col("upto") >= F.col("need")).groupBy("query").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("over")), "bin").alias("k"))
        over = F.col("found") | F.col("k").isNull()
        low = F.col("low") + F.col("k.bin") * width
        state = stored(state.join(kth, "query", "left").select(
            "id", "v", "query",
            F.when(over, F.col("low")).otherwise(low).alias("low"),
            F.when(over, F.col("high")).otherwise(F.least(F.col("high"), low + width)).alias("high"),
            F.when(over, F.col("need")).otherwise(F.col("need") - F.col("k.over")).alias("need"),
            (over | (width == 1)).alias("found"),
        ), "topk-state")
    hits = _meet(blocks, _query_blocks(state, query_rows), slots).mapInArrow(_at_least(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(state: DataFrame, rows: int) -> DataFrame:
    """Query blocks that carry (query, low, high, need) of each row as longs."""

    def with_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                longs = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("query", "low", "high", "need")]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array([x.tobytes() for x in longs], pa.binary())], names=["id", "v", "state"])

        yield from _packed(rows)(joined())

    return state.repartition("query").mapInArrow(with_state, _BLOCK)
