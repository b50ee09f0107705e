import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import connect, difference
from conftest import TABLES
from veritable import llm
from odd_rows import odd_docs  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_queries_are_registered():
    names = entry.queries()
    assert set(llm.QUERIES) <= set(names) and "pipeline" in names
    assert {name.split("_")[0] for name in llm.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert difference(llm.QUERIES[name](spark, TABLES), connect(TABLES), llm.ORACLES[name]) is None


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, TABLES)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left and left <= ids
            ids = left
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, TABLES).count() == docs.count()


def test_stages_take_odd_and_empty_tables(spark, odd_docs, tmp_path):
    for k, docs in enumerate((odd_docs, odd_docs.limit(0))):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, TABLES).write.parquet(f"{tmp_path}/{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{n}")


def test_labelled_good_documents_are_kept(spark):
    folder = TABLES.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").join(docs, "doc_id").filter(F.size(F.split("text", r"\s+")) >= 60)
    kept = corpus_pipeline.quality(spark, docs, folder).join(good.select("doc_id"), "doc_id").count()
    assert kept >= 0.99 * good.count()
