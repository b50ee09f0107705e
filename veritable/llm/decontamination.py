"""Benchmark decontamination by winnowing, in built-in expressions only.

A window is `window_words` consecutive words of a benchmark item; an item of fewer words is one
window. A document word is hit if it lies in any occurrence of a window.

1. Fingerprints: of each window the least hash of its runs of `gram_words` words. Windows with
   equal words have equal fingerprints, so every shared span of `window_words` words shares at
   least one. Neighbouring windows mostly keep the same run, which makes the sequence sparse. A
   window of a short item is a single run, and its hash the fingerprint; documents are
   fingerprinted once more for each such length that the benchmark has (at most
   `window_words` - 1).
2. Join: a bitmap of fixed size of all benchmark fingerprints goes to every task as a literal and
   leaves in each document only the places whose fingerprint may be shared; those are written
   with the words of their windows, and nothing else of a text is. They are joined with the
   benchmark's windows on fingerprint and words, over salted keys, so a passage that a third of
   all documents share is spread. A benchmark too large for the bitmap makes it useless, not wrong.
3. Extension: matching windows that overlap or touch are merged into spans of document words.

Windows with the same list of items share a class. A document has a set of classes, and equal
sets, which copies of a passage give, are turned into item lists once.

Words are runs of characters other than ASCII ones that are no digit or letter, lower-cased in
A-Z only. Defined cases: a null or empty text has no words, so it hits nothing and is hit by
nothing; rows of the benchmark without an id hit words but are not listed; rows with equal ids are one
item, whose texts all count. Repeated documents each get their row; an empty table gives none, an
empty benchmark no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.license_scan import plain_words
from veritable.llm.shared import stored

WINDOW_WORDS = 10
GRAM_WORDS = 4
#: Longs of the bitmap of benchmark fingerprints: 128 KB, whatever the size of the benchmark.
FILTER_LONGS = 1 << 14
#: Parts into which each key of a join with documents is split.
SALTS = 16


def _words(table: DataFrame, key: Column, text: str) -> DataFrame:
    """key, n_words, and the words as `w`; an empty text has one empty word, which no window holds."""
    plain = table.select(key.alias("key"), plain_words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("p"))
    split = plain.select("key", "p", F.split("p", " ").alias("w"))
    return split.select("key", F.when(F.col("p") == "", F.lit(0)).otherwise(F.size("w")).cast("long").alias("n_words"), "w")


def _pairwise(df: DataFrame, made: str, source: str, apart: int, combine) -> DataFrame:
    """A column of combine(x[i], x[i + apart]) for each place i; past the end the second is null.

    A projection of its own: the array it reads is a column, which is not computed again for each place.
    """
    cell = F.transform(source, lambda x, i: combine(x, F.get(source, i + apart)))
    return df.select("*", cell.alias(made))


def _doubled(df: DataFrame, name: str, first: str, size: int, combine) -> tuple[DataFrame, str]:
    """A column that combines `size` consecutive cells of the column `first`, in log2(size) steps."""
    now, span = first, 1
    while span < size:
        step = min(span, size - span)
        made = f"{name}{span + step}"
        if made not in df.columns:
            df = _pairwise(df, made, now, step, combine)
        now, span = made, span + step
    return df, now


def _fingerprints(words: DataFrame, lengths: list[int], window_words: int, gram_words: int) -> DataFrame:
    """A column `f<length>` for each length of window: the fingerprint of the window at each place."""
    df = words.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("g1"))
    for length in lengths:
        gram = min(gram_words, length) if length == window_words else length
        df, grams = _doubled(df, "g", "g1", gram, F.xxhash64)
        df, least = _doubled(df, f"m{gram}_", grams, length - gram + 1, F.least)
        df = df.withColumnRenamed(least, f"f{length}") if least.startswith("m") else df.select("*", F.col(least).alias(f"f{length}"))
    return df


def _places(length: int) -> Column:
    """Places where a window of that length starts."""
    return F.when(F.col("n_words") >= length, F.sequence(F.lit(0), (F.col("n_words") - length).cast("int"))).otherwise(F.array().cast("array<int>"))


def _windows(length: int, places: Column) -> Column:
    """The windows at those places as structs: first word, number of words, fingerprint, and words."""
    return F.transform(places, lambda at: F.struct(
        at.alias("low"), F.lit(length).alias("size"), F.get(f"f{length}", at).alias("print"),
        F.array_join(F.slice("w", at + 1, length), " ").alias("window"),
    ))


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """Each distinct window once: size, print, window, and `items`, the sorted ids that have it."""
    words = _words(benchmark, F.col(f"`{id_column}`").cast("string"), text).filter("n_words > 0")
    lengths = list(range(1, window_words + 1))
    made = _fingerprints(words, lengths, window_words, gram_words)
    whole = F.lit(None)
    for length in lengths:
        fits = F.col("n_words") >= window_words if length == window_words else F.col("n_words") == length
        whole = F.when(fits, _windows(length, _places(length))).otherwise(whole)
    each = made.select("key", F.inline(whole)).select("key", "size", "print", "window")
    return each.groupBy("size", "print", "window").agg(F.array_sort(F.collect_set("key")).alias("items"))


def _bitmap(windows: DataFrame) -> Column:
    """The fingerprints as an array literal of FILTER_LONGS longs, one bit for each fingerprint."""
    bits = windows.select(F.pmod("print", F.lit(FILTER_LONGS)).alias("at"), F.expr("shiftleft(1L, cast(shiftright(print, 40) & 63 as int))").alias("bit"))
    set_ = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = windows.sparkSession.range(FILTER_LONGS).join(set_, F.col("id") == F.col("at"), "left")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda s: s["bits"])
    return F.split(F.lit(every.agg(F.array_join(cells, ",")).first()[0]), ",").cast("array<bigint>")


def _in(bitmap: Column, print_: Column) -> Column:
    cell = F.get(bitmap, F.pmod(print_, F.lit(FILTER_LONGS)).cast("int"))
    return F.getbit(cell, F.shiftright(print_, 40).bitwiseAND(F.lit(63)).cast("int")) == 1


def _shared(length: int, bitmap: Column) -> Column:
    """Places of windows whose fingerprint may be one of the benchmark."""
    return F.filter(_places(length), lambda at: _in(bitmap, F.get(f"f{length}", at)))


def _salted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows that have a number `rid` with a table of unique keys; a hot key is split by that number."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def _merged(spans: Column) -> Column:
    """Sorted windows (low, end) as spans that neither overlap nor touch."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["low"].alias("low"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["low"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.array_append(done, s))

    return F.aggregate(spans, F.array().cast("array<struct<low:int,end:int>>"), add)


def _covered(spans: Column) -> Column:
    """Words in sorted windows (low, end), each counted once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["low"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"),
    ), lambda s: s["n"].cast("long"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and `spans`.

    `spans` lists the hit words as [low, end) numbers of words, merged.
    """
    windows = stored(benchmark_windows(benchmark, item_column, item_text, window_words, gram_words), "benchmark-windows")
    lengths = sorted(row["size"] for row in windows.select("size").distinct().collect())
    bitmap = _bitmap(windows)
    made = _fingerprints(_words(docs, F.col(f"`{id_column}`"), text), lengths, window_words, gram_words)
    none = F.array().cast("array<struct<low:int,size:int,print:bigint,window:string>>")
    shared = [_windows(n, _shared(n, bitmap)) for n in lengths]
    asked = stored(made.select(
        F.monotonically_increasing_id().alias("rid"), "key", "n_words", (F.concat(*shared) if shared else none).alias("asked"),
    ), "decontamination-asked")

    classed = windows.withColumn("class", F.sha2(F.to_json("items"), 256))
    places = asked.select("rid", F.inline("asked")).withColumnRenamed("size", "n")
    found = _salted(places, classed.select("print", "window", "class"), ["print", "window"])
    hits = found.groupBy("rid").agg(
        F.array_sort(F.collect_set(F.struct("low", (F.col("low") + F.col("n")).alias("end")))).alias("found"),
        F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"),
    )
    hits = stored(hits, "decontamination-hits")
    members = classed.select("class", "items").dropDuplicates(["class"])
    sets = hits.select("classes").distinct().select("classes", F.explode(F.split("classes", ",")).alias("class"))
    listed = sets.join(members, "class").select("classes", F.explode_outer("items").alias("item")).distinct()
    named = listed.groupBy("classes").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        "classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    known = _salted(hits, named, ["classes"])
    no_spans = F.array().cast("array<struct<low:int,end:int>>")
    return asked.select("rid", "key", "n_words").join(known, "rid", "left").select(
        F.col("key").alias(id_column), "n_words",
        F.coalesce(_covered(F.col("found")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("found").isNotNull().alias("contaminated"),
        F.coalesce(_merged(F.col("found")), no_spans).alias("spans"),
    )
