"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Each rule rejects documents whose ratio is above a cutoff.  Per stratum (language) and rule, labelled good documents
show how many each cutoff would reject wrongly.  A cutoff is certified if the exact binomial test rules out a false
rejection rate above ``risk`` / rules: P(Bin(n, rate) <= k) <= ``error`` / (rules x strata).  Cutoffs of one rule
are tested from lax to strict and k only grows, so the tests of one sequence need no further correction; rules
and strata are corrected by Bonferroni.  The strictest certified cutoff holds; without one the rule is off there.  So
with probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, unique_name

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
RISK = 0.02
ERROR = 0.05
#: Rules: ratio above cutoff is rejected; cutoffs from strict to lax.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "repeats": ("n_repeat_words / n", (0.05, 0.1, 0.15, 0.2, 0.25)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.6)),
    "shouts": ("n_shouts / n", (0.05, 0.1, 0.2, 0.4, 0.7)),
}
#: A table of cutoffs of more strata than this is joined by shuffle, not broadcast.
BROADCAST_STRATA = 10_000


def _covered(positions: Column, width: int) -> Column:
    """Words that windows of ``width`` at sorted ``positions`` cover."""
    parts = F.transform(positions, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(positions, j + 1) - p, F.lit(width))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur more than once in the text, the first one included."""
    def window(i):
        return F.xxhash64(*(F.get(words, i + j) for j in range(width)))

    hashes = F.when(F.size(words) > width, F.transform(F.sequence(F.lit(0), F.size(words) - width), window)
                    ).otherwise(F.array().cast("array<bigint>"))

    def positions(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda s, i: (F.get(sorted_, i - 1)["h"].eqNullSafe(s["h"]))
                         | (F.get(sorted_, i + 1)["h"].eqNullSafe(s["h"])))
        return F.sort_array(F.transform(again, lambda s: s["i"]))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(let(placed, positions), lambda p: _covered(p, width)))

    return let(hashes, count)


def with_features(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a struct column of the base counts of ``text`` (null: no words); its name is the second result."""
    name = unique_name(docs, "features")
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, GAP), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                             repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    both = F.struct(of_words.alias("w"), of_lines.alias("l"),
                    F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                    without(SYMBOLS).cast("long").alias("n_symbols"), without("!").cast("long").alias("n_shouts"))
    return docs.withColumn(name, both), name


def base_columns(f: str) -> list[Column]:
    return [F.col(f"{f}.w.n_words").alias("n_words"), F.col(f"{f}.word_chars").alias("word_chars"),
            F.col(f"{f}.n_symbols").alias("n_symbols"), F.col(f"{f}.l.n_dup_lines").alias("n_dup_lines"),
            F.col(f"{f}.w.n_repeat_words").alias("n_repeat_words"), F.col(f"{f}.l.n_lines").alias("n_lines"),
            F.col(f"{f}.n_shouts").alias("n_shouts")]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    return F.expr(RULES[rule][0].replace("/ n", "/ greatest(n_words, 1)") if RULES[rule][0].endswith("/ n")
                  else RULES[rule][0])


def binomial_log_cdf(k: Column, n: Column, rate: float) -> Column:
    """ln P(Bin(n, rate) <= k), summed in logarithms."""
    odds = math.log(rate / (1 - rate))
    start = n * F.lit(math.log1p(-rate))

    def step(s, i):
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(s["sum"] - term)))).alias("sum"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(start.alias("term"), start.alias("sum")), step,
                         lambda s: s["sum"])
    return F.when(k <= 0, start).otherwise(summed)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, n_good, <rule> cutoff per rule, null where none is certified).

    ``measured`` has doc_id, stratum and the counts; ``labels`` doc_id and quality (1 good).  A document with labels that
    disagree, or a null one only, is no good document.  One partial aggregate per task and stratum, whatever
    share of the rows a stratum has.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("worst")).where("worst = 1").select("doc_id")
    held = measured.join(good, "doc_id", "left_semi")
    sums = [F.sum((_ratio(r) > c).cast("long")).alias(f"{r}_{i}") for r, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    counted = materialise(held.groupBy("stratum").agg(F.count("*").alias("n_good"), *sums), "strata")
    rate, level, chosen = risk / len(RULES), math.log(error / (len(RULES) * max(1, counted.count()))), []
    for r, (_, cs) in RULES.items():
        tried = F.array(*(F.struct(F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("k")) for i, c in enumerate(cs)))
        # a count at or above the tested rate can't pass, and bounds the sum
        sure = F.filter(tried, lambda t: (t["k"] < rate * F.col("n_good"))
                        & (binomial_log_cdf(t["k"], F.col("n_good"), rate) <= level))
        chosen.append(F.array_min(F.transform(sure, lambda t: t["cut"])).alias(f"cut_{r}"))
    return counted.select("stratum", "n_good", *chosen)


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept."""
    cuts = materialise(cuts.drop("n_good"), "cutoffs").withColumnRenamed("stratum", "of_stratum")
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    joined = measured.join(cuts, F.col("stratum") == F.col("of_stratum"), "left")
    failed = base_failed()
    return (joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
            .drop("of_stratum", *(f"cut_{r}" for r in RULES)))


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, base_failed, kept) of each row of
    ``docs`` (doc_id, text, lang).

    A null text has no words and fails the base rules.  A null lang is a stratum of its own.  Without labels (or too few) the
    base rules alone decide.  No documents, no rows; other columns are ignored.
    """
    rows, f = with_features(docs.select("doc_id", "text", _stratum().alias("stratum")), F.col("text"))
    measured = materialise(rows.select("doc_id", "stratum", *base_columns(f)), "features")
    return judged(measured, cutoffs(measured, labels, risk, error)).drop("stratum")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns; see :func:`judge`."""
    whole = unique_name(docs, "whole")
    rows, f = with_features(docs, F.col("text"))
    measured = materialise(rows.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias(whole), F.col("doc_id"), _stratum().alias("stratum"),
        *base_columns(f)), "measured")
    kept = judged(measured, cutoffs(measured.drop(whole), labels, risk, error)).where("kept")
    return kept.select(f"{whole}.*")
