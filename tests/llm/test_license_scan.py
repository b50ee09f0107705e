import re

import pytest

from conftest import TABLES
from veritable.llm import license_scan as L
from odd_rows import odd_docs  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels, best = [], set(), 0.0
    for phrase, label in L.BASE:
        part = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(part)] == part]
        places += hits
        labels |= {label} if hits else set()
    base = ",".join(sorted(labels))
    for template in L.TEMPLATES:
        sentence, key = template.words, template.key.split()
        for at in range(-len(sentence), len(words)):
            share = sum(0 <= at + j < len(words) and words[at + j] == x for j, x in enumerate(sentence)) / len(sentence)
            from_ = at + template.key_at
            if share >= L.ACCEPTED and from_ >= 0 and words[from_ : from_ + len(key)] == key:
                labels.add(template.label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), 1.0 if places else best


def check(docs):
    got = {(r.doc_id, tuple(r)[1:]) for r in L.scan(docs).collect()}
    assert got == {(r.doc_id, brute(r.text)) for r in docs.collect()}


def test_documents(spark):
    check(spark.read.parquet(f"{TABLES}/documents.parquet"))


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert L.scan(odd_docs).count() == odd_docs.count() and L.scan(odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", [
    "All Rights Reserved. all rights reserved all rights reserved cc by cc by cc by-nc.",
    "This is Licensed under the Apache License, Version 2.0 and under MIT License", "cc by", "by cc by", "apache license version 2 0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this program", "general public\nlicense",
])
def test_phrases_and_templates(spark, text):
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def longest_in_order(words, sentence, at):
    """Plain table of the longest common run whose words stand at most SHIFT places from theirs."""
    best = {}
    for j, x in enumerate(sentence):
        for i in range(at + j - L.SHIFT, at + j + L.SHIFT + 1):
            same = 0 <= i < len(words) and words[i] == x
            best[j, i] = max(best.get((j - 1, i - 1), 0) + same, best.get((j - 1, i), 0), best.get((j, i - 1), 0))
    return max(best.values())


def brute_shifted(text):
    words, found = WORD.findall((text or "").translate(LOWER)), {}
    for template in L.TEMPLATES:
        sentence, key = template.words, template.key.split()
        for at in range(-len(sentence) - L.SHIFT, len(words) + L.SHIFT):
            from_ = [at + template.key_at + d for d in range(-L.SHIFT, L.SHIFT + 1)]
            share = longest_in_order(words, sentence, at) / len(sentence)
            if share >= L.ACCEPTED and any(f >= 0 and words[f : f + len(key)] == key for f in from_):
                found[template.label] = max(found.get(template.label, 0), share)
    return found


NOTICES = [
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("apache-2.0", "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required"),
    ("apache-2.0", "Licensed to you under the Apache License, Version 2.0 (the License)"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("lgpl", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software"),
    ("mit", "This program is licensed under MIT License."),
    ("bsd", "Redistribution and use of this software in source and binary forms, with or without any modification, are permitted"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License version 3"), ("", "licensed under CC BY-NC-SA 4.0"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at https"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("", "with or without fee is hereby granted permission to use copy modify"), ("", "mit license under the released"),
]


def test_notices_with_inserted_and_missing_words(spark):
    docs = spark.createDataFrame([(n, "some words before " * (n % 3) + text) for n, (_, text) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in L.scan(docs).collect()}
    for r in docs.collect():
        found = brute_shifted(r.text)
        labels, base_labels, score = got[r.doc_id]
        assert set(labels.split(",")) - {""} == set(found) | (set(base_labels.split(",")) - {""})
        assert score == (1.0 if base_labels else max(found.values(), default=0.0))
        assert ",".join(found) == NOTICES[r.doc_id][0]


def test_long_licensed_text_takes_time_in_proportion(spark):
    """A hundred thousand words of licence sentences."""
    import time

    text = " ".join(t.sentence for t in L.TEMPLATES)
    small, large = text, " ".join([text] * (100_000 // len(text.split()) + 1))
    table = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    want = L.scan(table(small)).first()
    start = time.time()
    got = L.scan(table(large)).first()
    assert got.labels == want.labels and got.n_words == len(large.split())
    assert time.time() - start < 30
