"""Quality rules as a short-circuit cascade, by Spark's own functions alone.

Every rule is an expression over a text's measures. What a rule costs and whom it rejects is estimated on a sample; rules
are then asked in the order of rejections per second, each only of the texts that no earlier one rejected (the branches of
a CASE, which Spark works out one after the other). The order changes the work, never the verdict.

Null texts have no words, and fail for it. Repeated words are found by 64-bit hashes of five-word windows within one
text: two different windows of a text of n words pass for one with probability n * n / 2^65."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .frames import cut, let, word_array

WINDOW = 5  # words
SYMBOLS = "[#*$%&|<>]"
SAMPLE = 2000  # rows that costs and rejections are estimated on, about


@dataclass(frozen=True)
class Rule:
    """`rejects` makes a condition from the column functions m(name) of a text's measures."""
    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _share_left_out(m, pattern: str) -> Column:
    """Characters of the words that match a pattern."""
    return F.length(m("joined")) - F.length(F.regexp_replace(m("joined"), pattern, ""))


RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("repeated lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("capitals", lambda m: 2 * _share_left_out(m, "[A-ZÀ-ÖØ-Þ]") > m("word_chars")),
    Rule("digits", lambda m: 3 * _share_left_out(m, "[0-9]") > m("word_chars")),
    Rule("few different words", lambda m: 20 * F.size(F.array_distinct(m("words"))) < m("n_words")),
)


def _repeated(hashes: Column) -> Column:
    """Words in windows found twice or more, from the hashes of a text's words."""
    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def words(p: Column) -> Column:
            steps = F.transform(p, lambda at, i: F.least(F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return let(placed, lambda s: let(places(s), words))

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    return F.when(F.size(hashes) < WINDOW, 0).otherwise(let(hashes, of)).cast("bigint")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` as one struct `row`, its words and their `joined` characters, and a text's measures."""
    known = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    split = known.select("row", word_array(F.col("text")).alias("words"),
                         F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"))
    listed = split.select("row", "words", F.array_join("words", "").alias("joined"),
                          F.size("lines").cast("bigint").alias("n_lines"),
                          (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                          F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return listed.select("row", "words", "joined", F.size("words").cast("bigint").alias("n_words"),
                         F.length("joined").cast("bigint").alias("word_chars"),
                         (F.length("joined") - F.length(F.regexp_replace("joined", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                         "n_dup_lines", _repeated(F.col("hashes")).alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def order_rules(measured: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE, total: int | None = None) -> list[Rule]:
    """The rules by rejections per second on a stored sample of about `sample` rows, greedily: the rejections of a rule
    are those of the rows that the rules before it let through."""
    total = measured.count() if total is None else total
    if not total or len(rules) < 2:
        return list(rules)
    some = cut((measured if total <= sample else measured.sample(sample / total, seed=7)).drop("row"))
    rejects = [rule.rejects(F.col) for rule in rules]
    # how many sampled rows have each combination of verdicts: at most 2 to the number of rules, and no more than rows
    met = [tuple(r) for r in some.groupBy(*[r.alias(f"r{i}") for i, r in enumerate(rejects)]).count().collect()]

    def seconds(*conditions: Column) -> float:
        tried = some.agg(F.count("words"), F.count("joined"), *[F.count_if(c) for c in conditions])
        took = []
        for _ in range(2):
            began = time.perf_counter()
            tried.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds()
    cost = [max(seconds(r) - idle, 1e-3) for r in rejects]
    left, order = set(range(len(rules))), []
    while left:
        best = max(sorted(left), key=lambda i: sum(row[-1] for row in met if row[i]) / cost[i])
        order.append(rules[best])
        left.discard(best)
        met = [row for row in met if not row[best]]
    return order


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` as struct `row` with their measures, `base_failed` and `kept`. No shuffle; one pass over the
    table besides the sample."""
    measured = with_measures(docs, text)
    order = order_rules(measured, rules, sample, docs.count())
    verdict = F.when(base_failed(), False)
    for rule in order:
        verdict = verdict.when(rule.rejects(F.col), False)
    return measured.select("row", *MEASURES, base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns as they were."""
    return judge(docs, rules, text).where("kept").select("row.*")
