"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.words import char_count, duplicate_lines, repeated_words, words

#: Rows on which the rules' cost and selectivity are measured, about, and characters of each at most.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 50_000
#: Runs of each rule, of which the median counts, the least cost that is told from none, and the ratio within which costs are equal.
RUNS, LEAST_SECONDS, ALIKE = 3, 0.05, 4.0
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """A document is rejected where reject holds; reject may use text and the base columns."""

    name: str
    reject: Column


def base_columns(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as empty.
    """
    own = F.col("_words")
    return (
        documents.withColumn("_words", words(F.col(text)))
        .withColumns(
            {
                "n_words": F.size(own).cast("long"),
                "word_chars": char_count(own),
                "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long"),
                "n_dup_lines": duplicate_lines(F.col(text)),
                "n_repeat_words": repeated_words(own),
            }
        )
        .drop("_words")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    )


def default_rules(text: str = "text") -> list[Rule]:
    """Rules beyond the base: each holds against a form of junk and leaves prose alone."""
    n, body = F.col("n_words"), F.coalesce(F.col(text), F.lit(""))
    capitals, letters = F.length(F.regexp_replace(body, r"\P{Lu}+", "")), F.length(F.regexp_replace(body, r"\P{L}+", ""))
    return [
        Rule("odd_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(body, "\n"))),
        Rule("capitals", 2 * capitals > letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
    ]


def _sampled(documents: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` documents of at most SAMPLE_CHARS characters each, with their base columns, in the partitions where they lie."""
    short = documents.where(F.coalesce(F.length(text), F.lit(0)) <= SAMPLE_CHARS)
    return base_columns(short.sample(min(1.0, rows / max(documents.count(), 1)), seed=7), text)


def measured_costs(sample: DataFrame, rejects: list[Column]) -> list[float]:
    """Seconds that each rule takes over the sample, less those of an empty rule.

    Runs of all rules alternate, after a first that is not counted, so that what
    else the machine does falls on all alike.
    """
    took: list[list[float]] = [[] for _ in range(len(rejects) + 1)]
    for run in range(RUNS + 1):
        for k, reject in enumerate([F.lit(False), *rejects]):
            started = time.perf_counter()
            sample.agg(F.count_if(reject)).collect()
            if run:
                took[k].append(time.perf_counter() - started)
    empty, *own = map(median, took)
    return [x - empty for x in own]


def level_of(seconds: float) -> float:
    """A cost with what lies within the spread of measurements made equal: LEAST_SECONDS times a whole power of ALIKE."""
    return LEAST_SECONDS * ALIKE ** max(0, round(math.log(max(seconds, LEAST_SECONDS) / LEAST_SECONDS, ALIKE)))


def ordered(documents: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, costs: Callable[[DataFrame, list[Column]], list[float]] = measured_costs) -> list[Rule]:
    """rules by rejections per second, best first.

    Cost is what a rule alone takes over a cached sample; costs that
    measurements can't tell apart count as equal. Each place goes to the rule
    with the most rejections, of the documents that all rules before it let
    pass, per cost; of equal ones to the cheaper, then the earlier one. The
    sample is bounded in rows and characters and decides the order only, never
    a verdict.
    """
    sample = _sampled(documents, text, sample_rows).cache()
    try:
        rejects = [F.coalesce(rule.reject, F.lit(False)) for rule in rules]
        # as many rows as the sample has, at most
        seen = [(r[:-1], r[-1]) for r in sample.groupBy(*(c.alias(f"_{k}") for k, c in enumerate(rejects))).count().collect()]
        cost = [level_of(x) for x in costs(sample, rejects)]
    finally:
        sample.unpersist()
    left, out = set(range(len(rules))), []
    while left:
        rejected = {k: sum(n for flags, n in seen if flags[k] and not any(flags[j] for j in out)) for k in left}
        best = min(left, key=lambda k: (-rejected[k] / cost[k], cost[k], k))
        left.remove(best)
        out.append(best)
    return [rules[k] for k in out]


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where all before it let the document pass."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.reject, F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(documents: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """documents with the base columns and kept: false where the base or a rule rejects.

    Null, empty and blank texts have no words and fail the base. Very long
    texts are judged whole. Rows are judged one by one, so repeated ones get
    equal verdicts; rules of equal worth go by cost, then as given, which
    changes no verdict. An empty table gives no rows. Columns of documents that
    are named like added ones are replaced.
    """
    rules = default_rules(text) if rules is None else rules
    rated = base_columns(documents, text)
    return rated.withColumn("kept", ~F.col("base_failed") & cascade(ordered(documents, rules, text) if len(rules) > 1 else rules))
