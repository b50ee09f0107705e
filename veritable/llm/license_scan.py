"""License scan by a positional index of rare words, in built-in expressions only.

A template is a sentence of a licence or of its usual notice as words, a label, and a mandatory
key phrase. The corpus gives the number of texts that hold each template word, and by it the IDF.

1. Lookup: a file is asked for the templates' rarest words of the corpus, as many of each template
   as may be missing at the accepted share plus one; a file without any holds no template.
2. Postings: of each template of which the file holds words enough, the words of highest IDF that
   the file holds are looked up, again as many as may be missing plus one, so a match holds one.
   Each place of such a word, minus the word's place in the template, proposes that start and those
   at most SHIFT words away.
3. Intersection: at a start the postings of all template words are intersected: what counts is the
   longest run of template words that stand in order, each at most SHIFT words from its place, so
   words may be inserted, missing or replaced.
4. Verification: a start counts if enough words are in that run and the key phrase stands whole at
   most SHIFT words from its place.

The starts that count do not depend on which words are looked up, only the work does. All of this
happens inside the row: nothing is shuffled but the word counts, which are as many as the
templates have words.

Base phrases are found separately, wherever their words stand consecutively.

Defined cases: a null text counts as empty, has no words and no labels. Repeated rows give
repeated rows; an empty table gives none. Other columns are ignored. Starts that tie give
the label once; labels are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.quality_rules import bind

# The base phrases and their labels, and the characters between words.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence sentence, and the phrase in it that must stand whole."""

    label: str
    sentence: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.sentence.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# Sentences of public licences and usual notices, lower-cased, without punctuation.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3 or later", "gnu affero general public license version 3"),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing"),
    Template("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "by nc 4"),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0 international"),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0 international"),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", "all copyright and related or neighboring rights"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0 which is available at", "eclipse public license 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3.0", "licensed under the general public license version 3", "the general public license version 3"),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation either version 3"),
    Template("gpl-3.0", "under the terms of the gnu general public license version 3 as published by the free software foundation", "gnu general public license version 3"),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "provided by the copyright holders and contributors as is"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included in all copies or substantial portions"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish"),
)
ACCEPTED = 0.75
SHIFT = 3
#: A template and a start as one number: starts of a text, and how far before it one may lie.
_STARTS, _BEFORE = 1 << 32, 1 << 16


def plain_words(text: Column) -> Column:
    """The words of the text, lower-cased in A-Z only, with one blank between them."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, SEPARATORS, " "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_counts(plain: DataFrame, templates: Sequence[Template]) -> tuple[int, dict[str, int]]:
    """The number of texts, and of those that hold each template word; bounded by the templates."""
    words = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(F.split("p", " "), F.lit(words))
    found = plain.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {row["w"]: row["count"] for row in found}
    return counts.pop("", 0), counts


def by_rarity(template: Template, counts: dict[str, int], texts: int) -> list[str]:
    """The template's distinct words, the highest IDF first."""
    idf = {w: math.log((texts + 1) / (counts.get(w, 0) + 1)) for w in template.words}
    return sorted(idf, key=lambda w: (-idf[w], w))


def spare(template: Template, accepted: float) -> int:
    """How many of the template's words a match may lack."""
    return len(template.words) - math.ceil(accepted * len(template.words))


def rarest(template: Template, ranked: list[str], accepted: float) -> list[str]:
    """The first of the ranked words, one place more than may be missing."""
    chosen: list[str] = []
    for word in ranked:
        if sum(template.words.count(w) for w in chosen) > spare(template, accepted):
            break
        chosen.append(word)
    return chosen


def _structs(rows: list[tuple], fields: str) -> Column:
    """A literal array of structs."""
    names = fields.split()
    return F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for row in rows])


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE, accepted: float = ACCEPTED, shift: int = SHIFT) -> DataFrame:
    """One row per document: words, base places, labels, and a score.

    The score is 1 where a base phrase stands, else the best share of template words of an
    accepted start, else 0.
    """
    plain = docs.select(F.col(id_column), plain_words(F.coalesce(F.col(text), F.lit(""))).alias("p"))
    texts, counts = word_counts(plain, templates)
    ranked = [by_rarity(t, counts, texts) for t in templates]
    indexed = sorted({w for t, words in zip(templates, ranked) for w in rarest(t, words, accepted)})
    held_words = sorted({w for t in templates for w in t.words})
    # a posting: word, template, place; the words of a template by falling IDF
    postings = F.array(*[_structs([(w, n, j) for w in words for j, x in enumerate(t.words) if x == w], "w t j") for n, (t, words) in enumerate(zip(templates, ranked))])
    spares = F.array(*[F.lit(spare(t, accepted)) for t in templates])
    shape = _structs([(t.label, len(t.words), t.key, t.key_at, len(t.key.split())) for t in templates], "label size key key_at key_size")
    sentences = F.array(*[F.lit(t.words) for t in templates])
    nothing = F.array().cast("array<struct<label:string,share:double>>")

    def in_order(w: Column, at: Column, sentence: Column) -> Column:
        """Template words in the longest run in order: one row of the table a template word, one cell a distance from its place."""
        def row(state: Column, x: Column) -> Column:
            def cell(done: Column, d: Column) -> Column:
                same = F.coalesce(F.get(w, state["at"] + d - shift) == x, F.lit(False)).cast("int")
                after = F.coalesce(F.get(state["best"], d + 1), F.lit(0))
                return F.array_append(done, F.greatest(F.get(state["best"], d) + same, after, F.coalesce(F.array_max(done), F.lit(0))))

            cells = F.aggregate(F.sequence(F.lit(0), F.lit(2 * shift)), F.array().cast("array<int>"), cell)
            return F.struct((state["at"] + 1).alias("at"), cells.alias("best"))

        none = F.array_repeat(F.lit(0), 2 * shift + 1)
        return F.aggregate(sentence, F.struct(at.alias("at"), none.alias("best")), row, lambda state: F.array_max(state["best"]))

    def starts_found(w: Column) -> Column:
        """(template, label, share) of each proposed start that counts."""
        near = F.sequence(F.lit(-shift), F.lit(shift))

        def looked_up(held: Column) -> Column:
            """Postings of the file's rarest words of each template that it holds enough of."""
            def of(all_: Column, n: Column) -> Column:
                few = F.filter(all_, lambda p: F.array_contains(held, p["w"]))
                return F.when(F.size(few) >= F.size(all_) - F.get(spares, n), F.slice(few, 1, F.get(spares, n) + 1)).otherwise(F.slice(few, 1, 0))

            return F.flatten(F.transform(postings, of))

        def proposed(posted: Column) -> Column:
            """Template and start of each place of a looked-up word, as numbers, which are made distinct by hashing; structs would be compared with each other."""
            placed = F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            places = bind(F.array_distinct(F.transform(posted, lambda p: p["w"])), lambda wanted: F.filter(placed, lambda s: F.array_contains(wanted, s["x"])))
            return F.array_distinct(F.flatten(F.flatten(F.transform(places, lambda s: F.transform(
                F.filter(posted, lambda p: p["w"] == s["x"]),
                lambda p: F.transform(near, lambda d: p["t"].cast("long") * _STARTS + (s["i"] - p["j"] + d + _BEFORE)))))))

        def keyed(c: Column) -> Column:
            one = F.get(shape, c["t"])
            whole = lambda from_: (from_ >= 0) & (F.array_join(F.slice(w, F.greatest(from_, F.lit(0)) + 1, one["key_size"]), " ") == one["key"])
            return F.exists(near, lambda d: whole(c["at"] + one["key_at"] + d))

        def judged(c: Column) -> Column:
            one = F.get(shape, c["t"])
            return F.struct(one["label"].alias("label"), (in_order(w, c["at"], F.get(sentences, c["t"])) / one["size"]).alias("share"))

        def counted(posted: Column) -> Column:
            starts = F.transform(proposed(posted), lambda c: F.struct(
                F.floor(c / _STARTS).cast("int").alias("t"), (F.pmod(c, F.lit(_STARTS)) - _BEFORE).cast("int").alias("at")))
            return bind(F.filter(starts, keyed), lambda found: F.filter(F.transform(found, judged), lambda c: c["share"] >= accepted))

        def of_file(held: Column) -> Column:
            return F.when(F.arrays_overlap(held, F.lit(indexed)), bind(looked_up(held), counted)).otherwise(nothing)

        return bind(F.array_intersect(w, F.lit(held_words)), of_file)

    line = F.concat(F.lit("^ "), F.col("p"), F.lit(" "))
    steps = plain.select(
        id_column, F.when(F.col("p") == "", F.lit(0)).otherwise(blanks(F.col("p")) + 1).cast("long").alias("n_words"), line.alias("line"), "p",
    ).select(
        id_column, "n_words",
        *[F.when(F.contains(F.col("line"), F.lit(f" {phrase} ")), F.split("line", f"(?= {phrase} )")).alias(f"b{k}") for k, (phrase, _) in enumerate(base)],
        (bind(F.split("p", " "), starts_found) if templates else nothing).alias("found"),
    )
    parts = [F.col(f"b{k}") for k in range(len(base))]
    first = [blanks(F.get(b, F.lit(0))).cast("long") for b in parts]
    last = [F.col("n_words") - (blanks(F.element_at(b, -1)).cast("long") - 1) for b in parts]
    base_labels = F.array_compact(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(parts, base)]))
    labels = F.array_union(base_labels, F.transform("found", lambda c: c["label"]))
    n_base = sum((F.when(b.isNull(), F.lit(0)).otherwise(F.size(b) - 1) for b in parts), F.lit(0)).cast("long")
    return steps.select(
        id_column, "n_words", n_base.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0))).alias("score"),
    )
