"""N-gram Jaccard join: all pairs of texts whose word shingles overlap by a given share.

1. Texts with the same set of shingles are one class; only one text of a class goes on.
2. A MinHash signature is cut into trees of a few hashes; a tree's hashes, written as bytes, are a
   path in a prefix trie. The paths of all classes are sorted, tree by tree, and neighbours
   tell how long a prefix each path shares with any other. Paths that share too little go.
3. Prefixes start at full length. Classes of one prefix are met: the first of them leads, those
   near to it in signature are linked to it, and of those that are not very near the next one
   leads. A class is settled when its company is so near that prefixes of this length find the
   like with the chance `recall`; for the others prefixes are shortened by one more hash, down
   to the length at which any pair at the threshold is found with that chance.
4. Connected classes are compared exactly, in blocks of a bounded number of texts, so that a pair
   is looked at once and large groups spread over many tasks. Blocks give counts of links and
   spanning edges, never the pairs.

Distances of signatures (hashes in which two differ) obey the triangle inequality. So, if a pair
differs in at most `slack` hashes and one of the two is within NEAR of a leader, the other is
within NEAR + slack of it and is linked too: no pair is lost for being met through a leader.
`slack` is five standard deviations above what a pair at the threshold differs in. Texts that
only share a passage meet now and then, but are not linked, as their signatures are far apart.

Shingles are runs of `shingle_words` white-space separated words; a shorter text is one shingle.
Jaccard is exact on sets of 64-bit shingle hashes.

Defined cases: a text without a word, or null, is linked to nothing, not even to another such
text, and is its own group. Repeated rows, with equal or with other ids, belong to one class.
An empty table gives no rows. Ties for a group's first document go to the smallest id; a null
id loses to others. Other columns are ignored; `drop_near_duplicates` passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.components import components
from veritable.llm.shared import mix, slices, span_hashes, stored, text_bytes, word_spans

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
#: Differing hashes up to which a class is left to the leader it has met.
NEAR = 8
BLOCK_TEXTS = 256
#: Leaders of one prefix that are compared as a block.
BLOCK_LEADERS = 512
#: Bytes of text in a block on average; a longer text is one of its own.
BLOCK_BYTES = 8 << 20
_COLUMNS = 4096


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = word_spans(raw, offsets)
    h = span_hashes(raw, starts, ends)
    run = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        run = run * np.uint64(0x100000001B3) + h[k : k + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
        else:
            out.append(h[:0])
    return out


def _node(shingles: np.ndarray) -> bytes | None:
    """A 128-bit name of a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """Per row of (i, tid, t): its class name, its trees' paths (4 bytes a hash), and a sketch of them (1 byte a hash)."""
    rng = np.random.default_rng(11)
    a = rng.integers(1, 1 << 62, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, trees * depth, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = shingle_sets(*text_bytes(batch.column("t")), words)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            paths = np.zeros((len(sets), trees * depth), ">u4")
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                starts = np.cumsum(sizes[full]) - sizes[full]
                for k in range(trees * depth):
                    paths[full, k] = np.minimum.reduceat(flat * a[k] + b[k], starts) >> np.uint64(32)
            names = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("i"), batch.column("tid"), pa.array(names, pa.binary()),
                pa.array([p.tobytes() if n else None for p, n in zip(paths, names)], pa.binary()),
                pa.array([p.tobytes() if n else None for p, n in zip(paths.astype(np.uint8), names)], pa.binary()),
                pc.fill_null(pc.binary_length(batch.column("t")), 0).cast(pa.int64()),
            ], names=["i", "tid", "node", "paths", "sketch", "bytes"])

    kind = docs.schema["i"].dataType.simpleString()
    return docs.select("i", "tid", "t").mapInArrow(run, f"i {kind}, tid binary, node binary, paths binary, sketch binary, bytes long")


def chance(similarity: float, depth: int, trees: int) -> float:
    """That a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def slack(threshold: float, hashes: int) -> int:
    """Hashes in which a pair at the threshold may differ: five standard deviations above the mean."""
    return int((1 - threshold) * hashes + 5 * (threshold * (1 - threshold) * hashes) ** 0.5)


def settled_within(depth: int, trees: int, full: int, recall: float) -> int:
    """The most differing hashes of a signature at which a pair is still found at this depth with the chance `recall`; -1 if none."""
    n = trees * full
    return max((k for k in range(n + 1) if chance(1 - k / n, depth, trees) >= recall), default=-1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values are all of this width, one row each."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width].reshape(-1, width)


def _company(full: int, floor: int):
    """Of sorted paths those that share `floor` hashes or more with a neighbour, with the most they share.

    A path at the border of a batch counts as if it shared all with what lies beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy()
            path = _matrix(batch.column("path"), 4 * full).reshape(-1, full, 4)
            same = (path[1:] == path[:-1]).all(axis=2) & (tree[1:] == tree[:-1])[:, None]
            common = np.r_[full, np.cumprod(same, axis=1).sum(axis=1), full]
            most = np.maximum(common[1:], common[:-1])
            part = batch.append_column("company", pa.array(most.astype(np.int32)))
            yield part.filter(pa.array(most >= floor))

    return run


def tries(classes: DataFrame, trees: int, full: int, floor: int) -> DataFrame:
    """(node, tree, path, company): the sorted paths of all trees that share a prefix of `floor` hashes or more."""
    step, parts = 4 * full, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = classes.select("node", F.posexplode(F.array(*[F.substring("paths", k * step + 1, step) for k in range(trees)])).alias("tree", "path"))
    order = ["tree", "path", "node"]
    return paths.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _company(full, floor), "node binary, tree int, path binary, company int")


def _led(sketches: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of one prefix: the leaders, and for each member the first one it is connected to and the
    greatest distance at which it is linked (-1: to nobody)."""
    count = len(sketches)
    pool, leaders, first, worst = np.arange(count), [], np.arange(count), np.full(count, -1)
    while len(pool):
        head, pool = pool[0], pool[1:]
        leaders.append(head)
        far = (sketches[pool] != sketches[head]).sum(axis=1)
        near = far <= reach
        if near.any():
            linked = pool[near]
            worst[linked] = np.maximum(worst[linked], far[near])
            worst[head] = max(worst[head], far[near].max())
            joined = np.zeros(count, bool)
            joined[first[linked]] = True
            joined[first[head]] = True
            if joined.sum() > 1:
                first[joined[first]] = joined.argmax()
        pool = pool[far > NEAR]
    return np.array(leaders), first, worst


def _meet(hashes: int, reach: int):
    """One link for each class of a prefix, to the first it is connected to there, of rows in the order of
    the prefixes. Leaders of a prefix that the border of a batch may cut come with their sketches,
    to be compared across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, prefix = batch.column("tree").to_numpy(), batch.column("prefix")
            new = np.r_[True, (tree[1:] != tree[:-1]) | pc.not_equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], n]
            sketches = _matrix(batch.column("sketch"), hashes)
            member, least, far, cut = [], [], [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                heads, first, worst = _led(sketches[a:b], reach)
                at = np.flatnonzero(worst >= 0)
                member.append(at + a)
                least.append(first[at] + a)
                far.append(worst[at])
                if a == 0 or b == n:
                    cut.append(heads + a)
            member, least, far, cut = (np.concatenate(x) for x in (member, least, far, cut))
            node = batch.column("node")
            nothing = pa.nulls(len(member), pa.binary())
            columns = [
                pa.concat_arrays([node.take(pa.array(member)), node.take(pa.array(cut))]),
                pa.concat_arrays([node.take(pa.array(least)), node.take(pa.array(cut))]),
                pa.array(np.r_[far, np.zeros(len(cut), np.int64)].astype(np.int32)),
                pa.array(np.r_[np.zeros(len(member), np.int32), tree[cut]].astype(np.int32)),
                pa.concat_arrays([nothing, prefix.take(pa.array(cut)).cast(pa.binary())]),
                pa.concat_arrays([nothing, batch.column("sketch").take(pa.array(cut)).cast(pa.binary())]),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if k < 2 else c for k, c in enumerate(columns)],
                                             names=["a", "b", "far", "tree", "prefix", "sketch"])

    return run


def _meet_leaders(hashes: int, reach: int):
    """Links between leaders of one prefix, block pair by block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            sketches = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint8).reshape(-1, hashes)
            far = np.zeros((len(held), len(held)), np.int32)
            for k in range(hashes):
                far += sketches[:, k][:, None] != sketches[:, k][None, :]
            linked = far <= reach
            np.fill_diagonal(linked, False)
            least, worst = _least_linked(linked), np.where(linked, far, -1).max(axis=1)
            at = np.flatnonzero(worst >= 0)
            return pa.RecordBatch.from_arrays([
                pa.array([held[k]["a"] for k in at], pa.binary()), pa.array([held[k]["a"] for k in least[at]], pa.binary()),
                pa.array(worst[at].astype(np.int32)),
            ], names=["a", "b", "far"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["tree"], row["prefix"], row["low"], row["high"])
                if here != key:
                    if held:
                        yield done()
                    key, held = here, []
                held.append(row)
        if held:
            yield done()

    return run


def candidates(classes: DataFrame, threshold: float, trees: int, full: int, recall: float) -> DataFrame:
    """(a, b, far, depth): links whose connected classes hold every pair to be compared.

    A class is linked to the least one it is connected to under a prefix, which may be itself. `far` is the
    most hashes in which `a` differs from a class it was linked to there, `depth` the length of the prefix.
    """
    spark, hashes = classes.sparkSession, trees * full
    parts, reach = int(spark.conf.get("spark.sql.shuffle.partitions")), slack(threshold, hashes)
    floor = next((d for d in range(full, 1, -1) if chance(threshold, d, trees) >= recall), 1)
    trie = stored(tries(classes, trees, full, floor), "jaccard-trie")
    sketches, active, found = classes.select("node", "sketch"), None, None
    for depth in range(full, floor - 1, -1):
        here = trie.filter(F.col("company") >= depth).select("node", "tree", F.substring("path", 1, 4 * depth).alias("prefix"))
        if active is not None:
            alive = here.join(active, "node", "left_semi").select("tree", "prefix").distinct()
            here = here.join(alive, ["tree", "prefix"], "left_semi")
        order = ["tree", "prefix", "node"]
        rows = here.join(sketches, "node").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        met = stored(rows.mapInArrow(_meet(hashes, NEAR + reach), "a binary, b binary, far int, tree int, prefix binary, sketch binary"), "jaccard-met")
        leaders = met.filter("sketch is not null").drop("b", "far")
        blocks = leaders.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("tree", "prefix", F.ceil(F.col("n") / BLOCK_LEADERS).cast("int").alias("blocks"))
        dealt = leaders.join(blocks, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "tree", "prefix", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "a", "sketch")
        keys = ["tree", "prefix", "low", "high"]
        across = paired.repartition(*keys).sortWithinPartitions(*keys, "a").mapInArrow(_meet_leaders(hashes, 2 * NEAR + reach), "a binary, b binary, far int")
        links = stored(met.filter("sketch is null").select("a", "b", "far").unionByName(across).groupBy("a", "b").agg(F.max("far").alias("far"))
                       .withColumn("depth", F.lit(depth)), "jaccard-edges")
        found = links if found is None else found.unionByName(links)
        if depth > floor:
            worst = found.groupBy(F.col("a").alias("node")).agg(F.max("far").alias("far"))
            settled = worst.filter(F.col("far") <= settled_within(depth, trees, full, recall))
            active = stored(trie.select("node").distinct().join(settled, "node", "left_anti"), "jaccard-active")
    return found


def _links(left: np.ndarray, right: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    either = left[:, None] + right[None, :] - both
    return both >= threshold * either - 1e-9


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, through 0/1 matrices of shared shingles."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        matrix = np.zeros((len(sets), min(_COLUMNS, int(shared.sum()) - low)), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def _least_linked(linked: np.ndarray) -> np.ndarray:
    """For each member the least member it is connected to."""
    label = np.arange(len(linked))
    while True:
        found = np.where(linked, label[None, :], len(label)).min(axis=1)
        found = np.minimum(label, found)
        found = found[found]
        if (found == label).all():
            return label
        label = found


def _compare(threshold: float, words: int):
    """Exact comparison of each block pair; the rows of one follow each other."""

    def block(rows: list[dict]) -> tuple[list, ...]:
        sets = shingle_sets(*text_bytes(pa.array([r["t"] for r in rows], pa.large_string())), words)
        sizes = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        linked = _links(sizes, sizes, both, threshold)
        np.fill_diagonal(linked, False)
        if rows[0]["low"] != rows[0]["high"]:
            side = np.array([r["block"] for r in rows])
            linked &= side[:, None] != side[None, :]
        copies = np.array([r["copies"] for r in rows])
        least = _least_linked(linked)
        names = [r["node"] for r in rows]
        return names, linked.sum(axis=1).tolist(), (linked @ copies).tolist(), [names[k] for k in least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            columns = block(held)
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.binary()),
            ], names=["node", "links", "linked_rows", "least"])

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["root"], row["low"], row["high"])
                if here != key:
                    if held:
                        yield done()
                    key, held = here, []
                if not held or row["node"] != held[-1]["node"]:
                    held.append(row)
        if held:
            yield done()

    return run


def join(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """One row per document: its class, its links and its group.

    `class_id` is the least id with the same set of shingles, `n_links` the number of other
    classes it is linked to, `n_linked_docs` the documents of those classes and the other
    documents of its own, `group_id` the least id connected to it.
    """
    return _joined(docs, id_column, text, threshold, shingle_words, trees, depth, recall, block_texts)[0]


def _joined(docs: DataFrame, id_column: str, text: str, threshold: float, words: int, trees: int, full: int, recall: float, block_texts: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(id_column).alias("i"), F.unhex(F.md5(text)).alias("tid"), F.col(text).alias("t"))
    signed = stored(signatures(rows, trees, full, words), "jaccard-signatures")
    classes = stored(
        signed.filter("node is not null").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("i").alias("class_id"),
            F.min(F.struct(F.col("i").isNull(), "i", "tid", "bytes")).alias("one"), F.any_value("paths").alias("paths"), F.any_value("sketch").alias("sketch"),
        ).select("node", "copies", "class_id", "one.i", "one.tid", "one.bytes", "paths", "sketch"), "jaccard-classes")
    edges = candidates(classes, threshold, trees, full, recall)
    found = stored(_compared(rows, classes, edges, threshold, words, block_texts), "jaccard-links")
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), "jaccard-groups")
    named = classes.select("node", "copies", "class_id").join(per_node, "node", "left").join(roots, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "jaccard-named")
    first = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    groups = named.join(first, "root")
    out = signed.select("i", "tid", "node").join(groups, "node", "left").select(
        "i", "tid",
        F.when(F.col("copies").isNull(), F.col("i")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("linked_rows", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_linked_docs"),
        F.when(F.col("copies").isNull(), F.col("i")).otherwise(F.col("group_id")).alias("group_id"),
        "root", "node",
    )
    return out.drop("tid", "root", "node").withColumnRenamed("i", id_column), out


def _compared(rows: DataFrame, classes: DataFrame, edges: DataFrame, threshold: float, words: int, block_texts: int) -> DataFrame:
    """Links and spanning edges among classes that these edges connect."""
    roots = stored(components(edges.select("a", "b"), "jaccard-candidates"), "jaccard-roots")
    held = classes.select("node", "copies", "i", "tid", "bytes").join(roots, "node")
    blocks = held.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block_texts, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    chosen = held.drop("bytes").join(blocks, "root")
    texts = rows.withColumnRenamed("i", "j").withColumnRenamed("tid", "text_id")
    held = chosen.join(texts, (F.col("tid") == F.col("text_id")) & F.col("i").eqNullSafe(F.col("j"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "t")
    spread = met.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    return spread.mapInArrow(_compare(threshold, words), "node binary, links long, linked_rows long, least binary")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one kept of each group, the one of the least id, with all columns."""
    _, out = _joined(docs, id_column, text, threshold, SHINGLE_WORDS, TREES, DEPTH, RECALL, BLOCK_TEXTS)
    kept = out.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("i").isNull(), "i", "tid")).alias("one"))
    chosen = kept.select(F.col("one.i").alias("__kept_id"), F.col("one.tid").alias("__kept_text"))
    tid = F.unhex(F.md5(F.col(f"`{text}`")))
    wordless = docs.filter(F.coalesce(F.translate(F.col(f"`{text}`"), " \t\n\x0b\x0c\r", ""), F.lit("")) == "")
    worded = docs.filter(F.translate(F.col(f"`{text}`"), " \t\n\x0b\x0c\r", "") != "")
    left = worded.join(chosen, (tid == F.col("__kept_text")) & F.col(f"`{id_column}`").eqNullSafe(F.col("__kept_id")), "left_semi")
    if left.select(tid.alias("t"), id_column).groupBy("t", id_column).count().filter("count > 1").isEmpty():
        return left.unionByName(wordless)
    return left.dropDuplicates([id_column, text]).unionByName(wordless)
