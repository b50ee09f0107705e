"""One query for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm import (
    byte_bpe, conversation_repair, decontamination, exact_topk, html_extraction, jaccard_join, language_mixture, license_scan, merkle_fixity, packing, quality_rules, suffix_dedup,
    whitening,
)
from veritable.llm.registry import query, table
from veritable.llm.shared import stored

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
e AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM e WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts
      FROM w LEFT JOIN p USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 40 * n_lines
               OR 100 * n_capitals > 40 * word_chars OR 100 * n_shouts > 30 * n_words
               OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM v
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


LEAKS_SQL = r"""
WITH b AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
v AS MATERIALIZED (
  SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
x AS (SELECT r, s, list(x) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w
      FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS s FROM d)),
p AS (SELECT r, m, s, array_to_string(w[1:m], ' ') AS win FROM x, (SELECT DISTINCT m FROM v) WHERE len(w) >= m),
h AS MATERIALIZED (SELECT r, s, m, item FROM p JOIN v USING (m, win)),
n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(s, s + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.measure(table(spark, folder, "documents"))


@query("op3_exact_topk", TOPK_SQL)
def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = exact_topk.whole_vectors(table(spark, folder, "embeddings"))
    return exact_topk.top_k(vectors, vectors.filter(vectors["id"] % 100 == 0))


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op8_cost_packing")
def op8_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, folder, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_mixture.predict(table(spark, folder, "documents"))


def _damaged(records: DataFrame) -> DataFrame:
    """A replica with planted faults: by the digest of the address, records lost, cut short, or changed."""
    mark = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    text = F.col("record").cast("string")
    return records.filter(mark != "00").withColumn("record", (
        F.when(mark == "01", F.expr("left(cast(record AS string), length(cast(record AS string)) - 9)"))
        .when(mark == "02", F.concat(F.expr("left(cast(record AS string), length(cast(record AS string)) - 5)"), F.lit("?\r\n\r\n")))
        .otherwise(text)).cast("binary")).withColumn("length", F.octet_length("record").cast("long"))


FIXITY_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record, url FROM pages),
m AS (SELECT *, left(md5(u), 2) AS mark FROM r),
d AS (SELECT page_id, url, record, mark,
             CASE mark WHEN '01' THEN left(record, length(record) - 9)
                       WHEN '02' THEN left(record, length(record) - 5) || '?' || chr(13) || chr(10) || chr(13) || chr(10)
                       WHEN '00' THEN NULL ELSE record END AS found FROM m)
SELECT page_id, url, CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS status,
       CAST(strlen(record) AS BIGINT) AS length, CAST(strlen(found) AS BIGINT) AS found_length,
       sha256(record) AS digest, sha256(found) AS found_digest
FROM d WHERE found IS NULL OR found <> record
"""


@query("op9_merkle_fixity", FIXITY_SQL)
def op9_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as archives, against a replica with planted faults: every record that differs."""
    records = stored(merkle_fixity.archive(table(spark, folder, "pages"), ["page_id", "url"]), "fixity-records")
    found = merkle_fixity.audit(records, _damaged(records), ["page_id", "url"])
    return found.select("page_id", "url", "status", "length", "found_length", "digest", "found_digest")


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


@query("op11_decontamination", LEAKS_SQL)
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _worn(conversations: DataFrame) -> DataFrame:
    """The conversations with planted faults, by a checksum of conversation and turn."""
    def filled(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    mark = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(F.col("mark") == 4, "user").otherwise(filled("role"))
    times = F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    marked = conversations.select("conv_id", "turn", "role", "text", mark.alias("mark")).filter("mark <> 0")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    repaired = conversation_repair.repair(_worn(conversations)).withColumnRenamed("conv_id", "of").withColumn("left", F.lit(True))
    known = conversations.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    empty = {n: F.lit(0).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return known.select("conv_id", *[F.when(F.col("left"), F.col(n)).otherwise(value).alias(n) for n, value in empty.items()])
