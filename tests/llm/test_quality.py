import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality

from .helpers import documents, empty_documents, odd_documents, words


def brute(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_base_counts(spark, make):
    docs = make(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert all(r.kept != r.base_failed for r in rows)  # too few labels for any cutoff


def test_repeats_at_every_size(spark):
    texts = [" ".join(str(i % p) for i in range(n)) for n in (7, 8, 9, 16, 17, 40, 200) for p in (1, 3, 8, 9, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    rows = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_binomial_bound(spark):
    cases = [(0, 100, 0.01), (3, 500, 0.01), (40, 9000, 0.005), (7, 7, 0.3)]
    for k, n, rate in cases:
        got = spark.range(1).select(quality.binomial_log_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), rate).alias("p")).first().p
        want = math.fsum(math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(got), want, rel_tol=1e-9)


def test_cutoffs_are_the_strictest_certified(spark):
    """Against the definition, on 6000 labelled documents of which some good ones have symbols."""
    def text(i):
        marks = 2 if i % 500 == 0 else 30 if i % 3 == 1 else 0  # of 60 words
        return " ".join(f"w{i}a{j}" + ("#" if j < marks else "") for j in range(60))

    n = 6000
    docs = spark.createDataFrame([(i, text(i), "en" if i % 2 else None) for i in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1)) for i in range(n)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    rate, level = quality.RISK / len(quality.RULES), quality.ERROR / (len(quality.RULES) * 2)
    for stratum in (0, 1):
        good = [i for i in range(n) if i % 3 != 1 and i % 2 == stratum]
        best = None
        for cut in sorted(quality.RULES["symbols"][1], reverse=True):
            k = sum(rows[i].n_symbols / rows[i].n_words > cut for i in good)
            p = math.fsum(math.comb(len(good), i) * rate ** i * (1 - rate) ** (len(good) - i) for i in range(k + 1))
            if p > level:
                break
            best = cut
        assert best is not None
        for i in range(stratum, n, 2):
            assert rows[i].kept == (rows[i].n_symbols / rows[i].n_words <= best)


def test_keep_good(spark):
    docs = documents(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    verdict = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdict
    assert quality.keep_good(odd_documents(spark), labels).columns == odd_documents(spark).columns
    assert quality.judge(empty_documents(spark), labels).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.judge(documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
