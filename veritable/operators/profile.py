"""Profile and data quality: summary, key numbers, blanks, duplicates, identifiers."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.dataset import Dataset
from veritable.functions.times import epoch_micros, iso_text
from veritable.operators.labels import short_label
from veritable.schema import DATE, NUMBER, ROW_ID, ColumnInfo, named_like_identifier
from veritable.session import localize, small_table

SMALL_SAMPLE = 30
MISSING_FLAG = 0.20
KEY_NUMBER_COLUMNS = 6
UNIQUE_SHARE = 0.95
DUPLICATE_EXAMPLES = 25
EXAMPLE_IDS = 1_000_000

# Hashes of repeated rows that are sent to all tasks.
SIEVE_HASHES = 100_000

# Rows of one monotonicity block; each block is one window partition.
BLOCK_ROWS = 1_000_000

# The sketch behind the distinct estimate errs by 5 %; a column estimated below this
# share of what it needs is too far off to be worth an exact distinct count.
CANDIDATE_SHARE = 0.70

BLOCK_AGGREGATES = 80


class Measures(NamedTuple):
    """Aggregates by name, and how to read one record per column off their result.

    Several of them can share one scan: see ``aggregate_once``.
    """

    aggregates: dict[str, Column]
    records: list[Column]

    def table(self, ds: Dataset, base: DataFrame | None = None) -> DataFrame:
        """One row per column, from ``base`` if it already holds the aggregates."""
        return per_column(aggregate_once(ds, self) if base is None else base, self.records)


def aggregate_once(ds: Dataset, *measures: Measures) -> DataFrame:
    """One wide row with all aggregates, computed in a single scan.

    Very wide tables take one scan per block of aggregates: Spark stops compiling an
    aggregate with too many buffers, and every block reads its own columns only.
    """
    merged = {name: value for m in measures for name, value in m.aggregates.items()}
    named = [value.alias(name) for name, value in merged.items()]
    blocks = [ds.df.agg(*named[i : i + BLOCK_AGGREGATES]) for i in range(0, len(named), BLOCK_AGGREGATES)]
    wide = blocks[0]
    for block in blocks[1:]:
        row = block.select(F.struct("*")).scalar().alias("block")
        wide = wide.select("*", row).select("*", "block.*").drop("block")
    return wide


def per_column(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn one wide aggregate row into one row per column, in the order given."""
    return df.select(F.inline(F.array(*structs)))


def schema_classes(ds: Dataset) -> DataFrame:
    """Name, class and type of every column, with the row count of the table."""
    records = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c.name).alias("name"),
            F.lit(c.kind).alias("type"),
            F.lit(c.sql_type).alias("sql_type"),
            F.lit(c.is_integer).alias("is_integer"),
            F.col("row_count"),
        )
        for i, c in enumerate(ds.columns)
    ]
    return per_column(ds.df.agg(F.count("*").alias("row_count")), records)


def _moment_text(info: ColumnInfo, value: Column) -> Column:
    return iso_text(value, is_date=isinstance(info.dtype, T.DateType))


def summary(ds: Dataset) -> DataFrame:
    """Per column: min, max, mean of numbers; min, max of dates; distinct values of text."""
    scalar = [(i, c) for i, c in enumerate(ds.columns) if c.kind in (NUMBER, DATE)]
    parts = []
    if scalar:
        aggregates = {}
        for i, c in scalar:
            aggregates |= {f"lo{i}": F.min(c.ref), f"hi{i}": F.max(c.ref)}
            if c.kind == NUMBER:
                aggregates[f"avg{i}"] = F.round(F.avg(c.ref.cast("double")), 4)
        records = [_summary_struct(i, c) for i, c in scalar]
        parts.append(Measures(aggregates, records).table(ds))
    if ds.texts:
        distinct = _distinct_texts(ds).groupBy("column").agg(F.count("key").alias("n"))
        # one row per text column, also where no row has a value
        schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType())])
        listed = small_table(ds.df.sparkSession, [(i, c.name) for i, c in enumerate(ds.columns) if c in ds.texts], schema)
        distinct = listed.join(distinct, "column", "left")
        empty = {"min_number": "double", "max_number": "double", "avg": "double",
                 "min_date": "string", "max_date": "string"}
        parts.append(
            distinct.select(
                "position",
                F.col("column").alias("name"),
                F.lit("text").alias("type"),
                *[F.lit(None).cast(t).alias(n) for n, t in empty.items()],
                F.coalesce("n", F.lit(0)).alias("distinct_values"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _summary_struct(i: int, c: ColumnInfo) -> Column:
    low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
    numeric = c.kind == NUMBER
    return F.struct(
        F.lit(i).alias("position"),
        F.lit(c.name).alias("name"),
        F.lit(c.kind).alias("type"),
        (low.cast("double") if numeric else F.lit(None).cast("double")).alias("min_number"),
        (high.cast("double") if numeric else F.lit(None).cast("double")).alias("max_number"),
        (F.col(f"avg{i}") if numeric else F.lit(None).cast("double")).alias("avg"),
        (F.lit(None).cast("string") if numeric else _moment_text(c, low)).alias("min_date"),
        (F.lit(None).cast("string") if numeric else _moment_text(c, high)).alias("max_date"),
        F.lit(None).cast("long").alias("distinct_values"),
    )


def label_counts(ds: Dataset, columns: list[ColumnInfo]) -> DataFrame:
    """Rows per (column, label), NULL labels included; long labels are shortened (see ``labels``)."""
    pairs = F.array(*[F.struct(F.lit(c.name).alias("column"), short_label(c).alias("label")) for c in columns])
    return ds.df.select(F.inline(pairs)).groupBy("column", "label").agg(F.count("*").alias("count"))


def _distinct_texts(ds: Dataset) -> DataFrame:
    """The different values of every text column, long ones by their digest."""
    pairs = [
        F.struct(F.lit(c.name).alias("column"), c.distinct_key.cast("string").alias("key")) for c in ds.texts
    ]
    return ds.df.select(F.inline(F.array(*pairs))).distinct()


def exact_sum(info: ColumnInfo) -> Column:
    """Sums of integers run in decimals: a long would overflow."""
    value = info.ref.cast("decimal(38,0)") if info.is_integer else info.ref
    return F.sum(value).cast("double")


def key_number_measures(ds: Dataset) -> Measures:
    aggregates, records = {}, []
    for i, c in enumerate(ds.numbers[:KEY_NUMBER_COLUMNS]):
        mean = F.avg(c.ref.cast("double"))
        stats = {"sum": exact_sum(c), "avg": mean, "min": F.min(c.ref), "max": F.max(c.ref)}
        for stat, value in stats.items():
            aggregates[f"key_{stat}{i}"] = F.round(value.cast("double"), 4)
        records.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c.name).alias("column"),
                *[F.col(f"key_{stat}{i}").alias(stat) for stat in stats],
            )
        )
    return Measures(aggregates, records)


def key_numbers(ds: Dataset, base: DataFrame | None = None) -> DataFrame:
    """Sum, mean, min and max of the first numeric columns."""
    if not ds.numbers:
        schema = "position int, column string, sum double, avg double, min double, max double"
        return ds.df.sparkSession.createDataFrame([], schema)
    return key_number_measures(ds).table(ds, base)


def date_measures(ds: Dataset) -> Measures:
    aggregates, records = {}, []
    for i, c in enumerate(ds.dates):
        aggregates |= {f"first{i}": F.min(c.ref), f"last{i}": F.max(c.ref)}
        low, high = F.col(f"first{i}"), F.col(f"last{i}")
        days = F.floor((epoch_micros(high) - epoch_micros(low)) / F.lit(86_400_000_000))
        records.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c.name).alias("column"),
                _moment_text(c, low).alias("min"), _moment_text(c, high).alias("max"),
                days.cast("long").alias("span_days"),
            )
        )
    return Measures(aggregates, records)


def date_range(ds: Dataset, base: DataFrame | None = None) -> DataFrame:
    """First date column with values: its first and last moment and the whole days between."""
    if not ds.dates:
        schema = "column string, min string, max string, span_days long"
        return ds.df.sparkSession.createDataFrame([], schema)
    ranges = date_measures(ds).table(ds, base).where("min IS NOT NULL")
    return ranges.orderBy("position").limit(1).drop("position")


def missing_measures(ds: Dataset) -> Measures:
    aggregates, records = {"total": F.count("*")}, []
    for i, c in enumerate(ds.columns):
        aggregates[f"blank{i}"] = F.count_if(c.blank)
        if c.is_float:
            aggregates[f"nan{i}"] = F.count_if(F.isnan(c.ref))
        share = F.when(F.col("total") > 0, F.col(f"blank{i}") / F.col("total")).otherwise(0.0)
        records.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("type"),
                F.col(f"blank{i}").alias("missing"),
                F.round(share, 4).alias("missing_fraction"),
                F.round(100 * share, 2).alias("missing_pct"),
            )
        )
    return Measures(aggregates, records)


def missing_by_column(ds: Dataset, base: DataFrame | None = None) -> DataFrame:
    """Blank values per column, in one scan."""
    return missing_measures(ds).table(ds, base)


def missing_flagged(ds: Dataset) -> DataFrame:
    """Columns with at least 20 % blanks, the worst first."""
    flagged = missing_by_column(ds).where(F.col("missing_fraction") >= MISSING_FLAG)
    return flagged.orderBy(F.desc("missing_fraction"), "position")


def row_digest(ds: Dataset) -> Column:
    """A 256-bit digest of the whole row, equal for equal rows only.

    Each value is written with its length before it, NULL as a length of its own, so that no
    two rows read alike. -0.0 counts as 0.0 and NaN as NaN, as in grouping.
    """
    parts = []
    for c in ds.columns:
        if c.is_float:
            text = (c.ref + F.lit(0.0).cast(c.dtype)).cast("string")
        elif isinstance(c.dtype, (T.StructType, T.ArrayType)):
            text = F.sha2(F.to_json(F.struct(c.ref)), 256)
        else:
            text = c.distinct_key.cast("string")
        parts.append(F.when(c.ref.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _row_hash(ds: Dataset) -> Column:
    """A 64-bit hash of the row, the same for equal rows; made from the values themselves, not from texts of them."""
    parts = []
    for c in ds.columns:
        if c.is_float:
            parts.append(c.ref + F.lit(0.0).cast(c.dtype))
        elif isinstance(c.dtype, (T.StructType, T.ArrayType)):
            parts.append(F.to_json(F.struct(c.ref)))
        else:
            parts.append(c.distinct_key)
        parts.append(c.ref.isNull())
    return F.xxhash64(*parts)


def repeated_candidates(ds: Dataset, most: int = SIEVE_HASHES) -> Dataset:
    """The rows that may have an equal: those whose hash occurs more than once.

    Only hashes are shuffled for it. Up to ``most`` such hashes are fetched and sent to all tasks
    (800 KB); with more of them most rows may have an equal, and the whole table is returned.
    """
    name = "__row_hash"
    hashed = ds.df.withColumn(name, _row_hash(ds))
    crowded = hashed.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name).limit(most + 1)
    found = [(row[0],) for row in crowded.collect()]
    if not found:
        return ds.where(F.lit(False))
    if len(found) > most:
        return ds
    table = small_table(ds.df.sparkSession, found, T.StructType([T.StructField(name, T.LongType())]))
    return replace(ds, df=hashed.join(F.broadcast(table), name, "left_semi").drop(name))


def duplicate_count(ds: Dataset, most: int = SIEVE_HASHES) -> DataFrame:
    """Rows beyond the first of each set of equal rows; copies are counted map-side."""
    rows = repeated_candidates(ds, most)
    copies = rows.df.groupBy(row_digest(ds).alias("row")).agg((F.count("*") - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows(ds: Dataset, most: int = SIEVE_HASHES) -> DataFrame:
    """The first row ids that repeat an earlier row.

    A row can only be among the first 25 repeats if it is among the first 26 of its own
    group. The rank filter is applied before the shuffle as well (WindowGroupLimit), so
    a group of copies of any size sends 26 digests and ids per task.
    """
    rank = F.row_number().over(Window.partitionBy("row").orderBy(ROW_ID))
    ranked = repeated_candidates(ds, most).df.select(row_digest(ds).alias("row"), ROW_ID).withColumn("copy", rank)
    repeats = ranked.where(F.col("copy") <= DUPLICATE_EXAMPLES + 1).where(F.col("copy") > 1)
    return repeats.select(ROW_ID).orderBy(ROW_ID).limit(DUPLICATE_EXAMPLES)


def duplicate_examples(ds: Dataset, rows: int) -> DataFrame:
    """``duplicate_rows`` of a table of known size, looked for at its beginning first.

    Whether a row repeats an earlier one depends on the rows before it only, so what is
    found among the first ids holds for the whole table.
    """
    if rows > EXAMPLE_IDS:
        early = localize(duplicate_rows(ds.where(F.col(ROW_ID) < EXAMPLE_IDS)))
        if early.count() == DUPLICATE_EXAMPLES:
            return early
    return duplicate_rows(ds)


def data_quality(ds: Dataset, base: DataFrame | None = None, counts: dict[int, int] | None = None) -> DataFrame:
    """Shape of the table, duplicates, mean blank share and the small-sample warning."""
    if base is None:
        base = aggregate_once(ds, missing_measures(ds), identifier_measures(ds))
    copies = F.lit(0).cast("long") if has_unique_column(ds, base, counts) else duplicate_count(ds).scalar()
    shares = [record["missing_fraction"] for record in missing_measures(ds).records]
    mean = sum(shares[1:], shares[0]) / len(shares)
    return base.select(
        F.col("total").alias("rows"),
        F.lit(len(ds.columns)).alias("columns"),
        F.lit(len(ds.numbers)).alias("numeric_columns"),
        F.lit(len(ds.dates)).alias("date_columns"),
        F.lit(len(ds.texts)).alias("text_columns"),
        copies.alias("duplicate_rows"),
        F.round(mean, 6).alias("mean_missing"),
        (F.col("total") < SMALL_SAMPLE).alias("small_sample"),
    )


def monotonic_violations(ds: Dataset, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often a value does not exceed the one before it, in row id order.

    LAG runs inside blocks of consecutive row ids; what happens between blocks is seen
    from the first and last value of each block, one small row per block.
    """
    info = ds.column(column, NUMBER)
    rows = ds.df.select(
        info.ref.alias("v"), F.col(ROW_ID).alias("r"),
        F.floor(F.col(ROW_ID) / F.lit(block_rows)).alias("block"),
    ).where("v IS NOT NULL")
    before = F.lag("v").over(Window.partitionBy("block").orderBy("r"))
    blocks = (
        rows.withColumn("before", before)
        .groupBy("block")
        .agg(
            F.count_if(F.col("v") <= F.col("before")).alias("inner_violations"),
            F.min_by("v", "r").alias("first"),
            F.max_by("v", "r").alias("last"),
            F.count("*").alias("n"),
        )
    )
    # one row per million ids, so a single window is enough here
    edge = F.col("first") <= F.lag("last").over(Window.orderBy("block"))
    return (
        blocks.withColumn("edge", F.when(edge, 1).otherwise(0))
        .agg(
            F.coalesce(F.sum(F.col("inner_violations") + F.col("edge")), F.lit(0)).alias("violations"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("values"),
        )
        .select(F.lit(column).alias("column"), "violations", "values")
    )


def _integers(ds: Dataset) -> list[ColumnInfo]:
    return [c for c in ds.numbers if c.is_integer]


def identifier_measures(ds: Dataset) -> Measures:
    """Rows, and the filled rows and bounds of the integer columns."""
    aggregates = {"total": F.count("*")}
    for i, c in enumerate(_integers(ds)):
        aggregates |= {f"filled{i}": F.count(c.ref), f"low{i}": F.min(c.ref), f"high{i}": F.max(c.ref)}
    return Measures(aggregates, [])


# A bitmap of 32,768 integers is worth its 4 KB where at least this many of them occur on average.
_BITMAP_FILL = 512
_BITMAP_BITS = 32_768


def _dense(seen: Row, i: int) -> bool:
    span = seen[f"high{i}"] - seen[f"low{i}"] + 1
    return span <= _BITMAP_BITS or span * _BITMAP_FILL <= seen[f"filled{i}"] * _BITMAP_BITS


def distinct_counts(ds: Dataset, seen: Row, needed: dict[int, float]) -> dict[int, int]:
    """Exact distinct counts of the integer columns that may reach what they need, in one job.

    The span of the integers bounds how many values there can be, which settles most
    columns; a sketch settles most others. Of what is left, integers that lie close together are
    counted in bitmaps of 32,768 each, which tasks fill before anything is shuffled; only sparse
    ones are shuffled value by value.
    """
    columns = _integers(ds)
    near = [
        i for i, enough in needed.items()
        if seen[f"filled{i}"] and seen[f"high{i}"] - seen[f"low{i}"] + 1 >= enough
    ]
    if not near:
        return {}
    estimates = ds.df.agg(*[F.approx_count_distinct(columns[i].ref) for i in near]).first()
    left = [i for i, estimate in zip(near, estimates) if estimate >= CANDIDATE_SHARE * needed[i]]
    if not left:
        return {}

    def each(chosen: list[int], value) -> DataFrame:
        cells = [F.when(columns[i].ref.isNotNull(), F.struct(F.lit(i).alias("i"), value(i).alias("v"))) for i in chosen]
        return ds.df.select(F.inline(F.array_compact(F.array(*cells))))

    dense, sparse = [i for i in left if _dense(seen, i)], [i for i in left if not _dense(seen, i)]
    parts = []
    if dense:
        rows = each(dense, lambda i: columns[i].ref.cast("long") - F.lit(seen[f"low{i}"]) + 1)
        maps = rows.groupBy("i", F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        parts.append(maps.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("n")))
    if sparse:
        values = each(sparse, lambda i: columns[i].ref.cast("long")).groupBy("i", "v").agg(F.lit(1).alias("one"))
        parts.append(values.groupBy("i").agg(F.count("*").alias("n")))
    return {row.i: row.n for row in reduce(DataFrame.unionByName, parts).collect()}


def identifier_counts(ds: Dataset, seen: Row) -> dict[int, int]:
    """Distinct counts for both uses: whether a column names rows, and whether one differs in all rows."""
    unique = UNIQUE_SHARE * seen.total
    integers = list(enumerate(_integers(ds)))
    needed = {i: min(unique, seen[f"filled{i}"]) for i, c in integers if not named_like_identifier(c.name)}
    full = [i for i, _ in integers if seen[f"filled{i}"] == seen.total > 0]
    # a column that has to differ in all rows only is not counted if the sketch is far from that
    needed |= {i: seen.total for i in full[:1] if i not in needed}
    return distinct_counts(ds, seen, needed)


def identifier_columns(ds: Dataset, base: DataFrame | None = None, counts: dict[int, int] | None = None) -> DataFrame:
    """Numeric columns that name rows rather than measure something, with the reason.

    They are named like one, or are integers that are (almost) all different or that
    increase with the row id. ``counts`` holds distinct counts where they are known.
    """
    found = [(c.name, "name") for c in ds.numbers if named_like_identifier(c.name)]
    probes = {i: c for i, c in enumerate(_integers(ds)) if not named_like_identifier(c.name)}
    if probes:
        seen = (aggregate_once(ds, identifier_measures(ds)) if base is None else base).first()
        unique = UNIQUE_SHARE * seen.total
        counts = identifier_counts(ds, seen) if counts is None else counts
        for i in probes:
            name, filled, distinct = probes[i].name, seen[f"filled{i}"], counts.get(i, -1)
            if distinct >= unique:
                found.append((name, "unique"))
            elif filled >= 2 and distinct == filled:
                if monotonic_violations(ds, name).first().violations == 0:
                    found.append((name, "increasing"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("column", "reason")])
    return small_table(ds.df.sparkSession, found, schema)


def has_unique_column(ds: Dataset, base: DataFrame, counts: dict[int, int] | None = None) -> bool:
    """Whether an integer column differs in all rows, so that no two rows can be equal.

    Counting one column's values is far cheaper than grouping whole rows.
    """
    seen = base.first()
    counts = identifier_counts(ds, seen) if counts is None else counts
    full = [i for i, _ in enumerate(_integers(ds)) if seen[f"filled{i}"] == seen.total > 0]
    return any(counts.get(i) == seen.total for i in full)


def measure_columns(ds: Dataset, base: DataFrame | None = None, counts: dict[int, int] | None = None) -> list[ColumnInfo]:
    """Numeric columns without the identifiers."""
    names = {row.column for row in identifier_columns(ds, base, counts).collect()}
    return [c for c in ds.numbers if c.name not in names]
