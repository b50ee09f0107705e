import zlib

import numpy as np

from conftest import TABLES
from veritable.llm import language_mixture as M
from odd_rows import odd_docs  # noqa: F401

SF = TABLES.replace("0.001", "0.01")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = M.predict(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_shares_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.train(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) between 3000 and 6000").collect()}
    full, selected = M.mixtures(model, [texts["en"][:3000] + " " + texts["fr"][:1000], texts["de"], None, "12 !"])
    en, fr = model.languages.index("en"), model.languages.index("fr")
    assert abs(full[0, en] - 0.75) < 0.12 and set(np.flatnonzero(selected[0])) == {en, fr}
    assert np.count_nonzero(selected[1]) == 1 and not selected[2:].any()


def test_likelihood_does_not_fall_with_more_rounds(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = M.train(docs)
    row, bucket, count = M.trigram_counts([r.text for r in docs.limit(20).collect()])
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    every = np.ones((len(starts), len(model.languages)))
    fits = [M._shares(model.chance[bucket], count.astype(float), starts, sizes, every, n)[1] for n in (1, 4, 16)]
    assert (fits[1] >= fits[0] - 1e-2).all() and (fits[2] >= fits[1] - 1e-2).all()


def test_odd_rows(odd_docs):
    rows = M.predict(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 5)} == {("und", 0.0)}
    kept = M.filter_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (2, 3, 5)").isEmpty()
    assert M.predict(odd_docs.limit(0)).collect() == []


def test_selected_languages_decide_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.lang: r.text for r in docs.filter("length(text) between 3000 and 6000").orderBy("doc_id").collect()}
    three = " ".join(texts[lang][:1000] for lang in sorted(texts)[:3])
    odd = [(-1, three, None), (-2, "これは学習していない言語の文章です。" * 40, None), (-3, texts["en"][:1500] + " これは学習していない言語の文章です。" * 20, None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = M.train(docs)
    full, selected = M.mixtures(model, [three])
    assert full.max() < 0.4 and np.count_nonzero(selected) == 3
    kept = {r.doc_id for r in M.filter_identified(rows).collect()}
    assert -1 in kept and -2 not in kept and -3 in kept
    assert kept >= {r.doc_id for r in docs.filter("length(text) > 200").collect()}
