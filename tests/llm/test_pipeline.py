import random

import corpus_pipeline as cp
from ledgerlens.llm import queries
from ledgerlens.llm.common import materialise

from .helpers import SF, documents, empty_documents, odd_documents, words
from .test_bagminhash import brute_classes
from .test_quality import brute
from .test_substring import boilerplate


def through(spark, docs):
    out = []
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
        out.append((name, docs))
    return out


def test_stages_take_effect_on_all_their_input(spark):
    docs = documents(spark)
    (_, good), (_, single), (_, cut), (_, mixed), (_, packed) = through(spark, docs)
    for d in (good, single, cut, mixed):
        assert d.columns == docs.columns
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    all_, kept = texts(docs), texts(good)
    assert set(kept) == {i for i, t in all_.items() if not brute(t)[5]}  # too few labels for cutoffs
    want = brute_classes(kept)
    assert set(texts(single)) == set(want.values())
    assert set(texts(cut)) <= set(texts(single))
    assert sum(len(words(t)) for t in texts(cut).values()) < sum(len(words(t)) for t in texts(single).values())
    total = sum(len(words(r.text)) for r in cut.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - total) < 0.1 * total
    assert packed.select("doc_id", "piece").where("piece = 0").count() == mixed.count()


def test_run(spark):
    rows = cp.run(spark, SF)
    assert set(rows.columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"} and rows.count() > 0


def test_odd_and_empty_tables(spark):
    for d in (odd_documents(spark), empty_documents(spark)):
        for name, out in through(spark, d)[:-1]:
            assert out.columns == d.columns, name


def test_substring_stage_cuts_passages_of_common_seeds(spark):
    """An edited passage goes though every part of it stands in many short pieces before."""
    texts = [" ".join(t) for t in boilerplate(random.Random(12), [(), (5,)])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in cp.repeated_passages(spark, docs, SF).collect()}
    n = len(texts) - 1
    assert [i for i, t in enumerate(texts) if left[i].text != t] == [n]
    assert words(left[n].text) == words(texts[n])[:40] + words(texts[n])[128:] and left[n].n_chars == len(left[n].text)


def test_every_operator_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 14)) and len(cp.STAGES) == 5
