"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule has an expression that says when a text is rejected. On a bounded sample the cascade
measures what each rule costs and how many texts it rejects, and orders the rules by rejections
per cost; a later rule is then evaluated only for texts that passed the ones before it. The
order changes the work, never the verdict: a text is kept if no rule rejects it.

Defined cases: a null text has no words and is rejected as too short, like an empty one. An
empty table gives an empty result. Other columns, whatever their names, are passed through by
`filter_quality` and ignored by `measure`. Repeated rows are judged one by one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the characters that count as symbols (fixed values).
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_WORDS = 50
SAMPLE_ROWS = 500


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows are sorted by hash, so equal ones are neighbours; the places of those with an equal
    neighbour are then sorted, and each adds the words up to the next such place, three at most.
    """

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        )
        found = bind(F.sort_array(windows), lambda s: F.filter(
            F.transform(s, lambda x, i: F.when(
                (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])),
            lambda p: p.isNotNull(),
        ))
        added = bind(F.sort_array(found), lambda p: F.transform(
            p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(words) >= 3, bind(words, of)).otherwise(F.lit(0).cast("long"))


def word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "")


@dataclass(frozen=True)
class Rule:
    """A name, the measures the rule reads, and when it rejects."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: Each measure from the text and its words, as a long.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: count_chars(t, SYMBOLS),
    "n_dup_lines": lambda t, w: bind(word_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda t, w: repeat_words(w),
    "n_lines": lambda t, w: F.size(word_lines(t)).cast("long"),
    "n_capitals": lambda t, w: count_chars(t, CAPITALS),
    "n_shouts": lambda t, w: count_chars(t, "!"),
}

RULES = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < MIN_WORDS),
    Rule("repeats_itself", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("capitals", ("n_capitals", "word_chars"), lambda m: 100 * m["n_capitals"] > 40 * m["word_chars"]),
    Rule("shouting", ("n_shouts", "n_words"), lambda m: 100 * m["n_shouts"] > 30 * m["n_words"]),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
)
BASE_RULES = ("too_short", "repeats_itself")


def rejection(rule: Rule, text: Column, words: Column) -> Column:
    return rule.rejects({name: MEASURES[name](text, words) for name in rule.reads})


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of at most `sample_rows` texts.

    The sample decides the order of evaluation only. Rules that reject nothing there come last,
    the cheaper ones first.
    """
    total = docs.count()
    if not total:
        return list(rules)
    drawn = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(min(1.0, 2 * sample_rows / total), seed=7)
    sample = drawn.limit(sample_rows).persist()
    try:
        sample.count()

        def timed(condition: Column) -> tuple[int, float]:
            start = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            return hits, time.perf_counter() - start

        timed(F.length("t") < 0)
        _, idle = timed(F.length("t") < 0)
        found = {}
        for rule in rules:
            hits, spent = timed(rejection(rule, F.col("t"), word_array(F.col("t"))))
            cost = max(spent - idle, 1e-4)
            found[rule.name] = (hits / cost, -cost)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda rule: found[rule.name], reverse=True)


def verdict(rules: Sequence[Rule], rejects: Callable[[Rule], Column]) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it did not."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rejects(rule), F.lit(False)).otherwise(out)
    return out


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text no rule rejects, with all their columns."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    order = ordered(docs, rules, text, sample_rows)
    # a filter would take its inputs in place of their names, and split the text for every rule
    return docs.filter(bind(word_array(value), lambda words: verdict(order, lambda rule: rejection(rule, value, words))))


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its measures, whether a base rule rejects it, and whether it is kept."""
    order = ordered(docs, rules, text, sample_rows)
    value = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(F.col(id_column), value.alias("t"), word_array(value).alias("w"), word_lines(value).alias("l"))
    of = {name: MEASURES[name](F.col("t"), F.col("w")) for name in MEASURES}
    of |= {
        "n_lines": F.size("l").cast("long"), "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
    }
    measured = words.select(id_column, *[column.alias(name) for name, column in of.items()])
    named = {name: F.col(name) for name in MEASURES}
    base = [rule for rule in order if rule.name in BASE_RULES]
    return measured.select(
        id_column, *MEASURES,
        (~verdict(base, lambda rule: rule.rejects(named))).alias("base_failed"),
        verdict(order, lambda rule: rule.rejects(named)).alias("kept"),
    )
