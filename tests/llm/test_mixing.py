from collections import defaultdict

from ledgerlens.llm import mixing

from .helpers import SF, documents, empty_documents, odd_documents, words


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / w for s in names}
        above = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def check(docs):
    rows = mixing.mix(docs).collect()
    sizes, want, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    target = brute_targets(dict(sizes))
    largest = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (r.times * r.size,) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        want[r.source] = r.target
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    times = defaultdict(set)
    for r in rows:
        times[r.source].add(r.times)
    assert all(max(t) - min(t) <= 1 for t in times.values())  # complete epochs first
    return rows


def test_targets_and_budgets(spark):
    rows = check(documents(spark, "/root/testdata/sf0.01"))
    assert len(rows) == 1000
    again = mixing.mix(documents(spark, "/root/testdata/sf0.01")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert len(check(docs)) == docs.count()


def test_caps_are_reshared(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (1, "b"), (400, "c"), (300, None), (100, "d"), (50, "d")])]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "a b c d", "s")] * 7 + [(2, "e f", "s"), (3, "g " * 40, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = sorted(r.times for r in mixing.mix(docs).collect() if r.doc_id == 1)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("doc_id = 1").count() == sum(times)


def test_mixed_documents_and_empty(spark):
    docs = documents(spark, SF)
    taken = sum(r.times for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(docs).count() == taken
    assert mixing.mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns
    assert mixing.mix(empty_documents(spark)).count() == 0
    assert mixing.mixed_documents(empty_documents(spark)).count() == 0
