from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import bagminhash

from .helpers import documents, empty_documents, odd_documents, words


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def similarity(a, b):
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 0.0


def brute_classes(texts):
    """Class (smallest id) by id, for unique ids: equal texts, similarity of 0.8 or more, and what these connect."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: bag(t) for i, t in texts.items()}
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if texts[i] is not None and texts[j] is not None and (
                    texts[i] == texts[j] or similarity(bags[i], bags[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("weights", [((1, 1, 1, 1), (1, 1, 1, 0)), ((5, 3, 0, 9), (2, 3, 7, 9)), ((100, 1, 1, 1), (60, 1, 1, 1))])
def test_components_agree_as_often_as_the_weighted_jaccard(weights):
    a, b = (np.array(w) for w in weights)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits, m, trials = 0, 64, 60
    for t in range(trials):
        elements = np.arange(4, dtype=np.uint64) * np.uint64(7919) + np.uint64(1_000_003 * t + 17)
        sig = [bagminhash.signatures(elements[w > 0], np.zeros((w > 0).sum(), int), w[w > 0], 1, m) for w in (a, b)]
        hits += (sig[0] == sig[1]).sum()
    n = m * trials
    assert abs(hits / n - want) < 5 * (want * (1 - want) / n) ** 0.5 + 0.01


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(5)
    gram, weight = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(1, 9, 300)
    row = np.sort(rng.integers(0, 10, 300))
    together = bagminhash.signatures(gram, row, weight, 10, 32)
    for r in range(10):
        mine = row == r
        alone = bagminhash.signatures(gram[mine], np.zeros(mine.sum(), int), weight[mine], 1, 32)
        assert (alone[0] == together[r]).all()


def test_classes_against_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in bagminhash.classes(docs).collect()}
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {i: r.class_id for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r.keeper) == sorted(set(want.values()))
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_chains_of_edits_and_a_large_group(spark):
    """A ladder of texts, each like its neighbours only, and many edits of one text."""
    base = [f"t{i}" for i in range(300)]
    step = [[f"v{max(0, s * 20 - i)}" if i < s * 20 else w for i, w in enumerate(base)] for s in range(8)]
    texts = [" ".join(s) for s in step]
    big = [f"g{i}" for i in range(200)]
    for j in range(60):
        e = list(big)
        e[(3 * j) % 200] = f"edit{j}"
        texts.append(" ".join(e))
    texts += [" ".join(big)] * 5 + ["z y x"] * 3
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert got == brute_classes(dict(rows))


def star(tag, copies, rng):
    """An original of 300 words and copies of it with 6 scattered edits each: like the original, not each other."""
    base = [f"{tag}{i}" for i in range(300)]
    out = [" ".join(base)]
    for c in range(copies):
        e = list(base)
        for x in range(6):
            e[50 * x + int(rng.integers(5, 45))] = f"{tag}edit{c}x{x}"
        out.append(" ".join(e))
    return out


def test_star_around_an_original_in_the_middle(spark):
    original, *copies = star("s", 1000, np.random.default_rng(3))
    texts = [*copies[:500], original, *copies[500:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similarity(bag(original), bag(copies[0])) >= 0.8 > similarity(bag(copies[0]), bag(copies[1]))
    assert {r.class_id for r in bagminhash.classes(docs).collect()} == {0}


def test_one_member_links_two_large_classes(spark):
    """Two stars whose originals are not alike; one copy of the first is a copy of the second, too."""
    first, *copies = star("a", 250, np.random.default_rng(5))
    far, bridge = first.split(), first.split()
    for x in range(12):
        far[25 * x + 2] = f"far{x}"
        if x < 6:
            bridge[25 * x + 2] = f"far{x}"
    others = []
    for c in range(250):
        e = list(far)
        for x in range(6):
            e[50 * x + 12 + c % 30] = f"other{c}x{x}"
        others.append(" ".join(e))
    texts = [*copies, *others, first, " ".join(bridge), " ".join(far)]
    bags = [bag(t) for t in texts[-3:]]
    alike = lambda x, y: sum((x & y).values()) / sum((x | y).values()) >= 0.8
    assert alike(bags[0], bags[1]) and alike(bags[1], bags[2]) and not alike(bags[0], bags[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in bagminhash.classes(docs).collect()} == {0}


def test_joining_against_all_pairs():
    """Links of a square: fewer than its classes, and they connect what all alike pairs connect."""
    rng = np.random.default_rng(11)
    n, threshold = 120, 0.8
    bags = []
    for c in range(n):
        b = {int(g): 1 + int(g) % 3 for g in rng.integers(0, 60, 30)} if c % 3 == 0 else dict(bags[-1])
        if c % 3:
            b[1000 + c] = 2
        bags.append(b)
    grams_of = [np.array(sorted(b), np.uint64) for b in bags]
    weights_of = [np.array([b[g] for g in sorted(b)], np.uint32) for b in bags]
    root = np.arange(n) // 2 * 2
    a, b = np.triu_indices(n, 1)
    a, b = a[root[a] != root[b]], b[root[a] != root[b]]
    got = bagminhash.joining(a, b, rng.integers(0, 9, len(a)), root, grams_of, weights_of, threshold)

    def groups(links):
        at = {i: int(r) for i, r in enumerate(root)}
        for x, y in links:
            old, new = sorted((at[x], at[y]), reverse=True)
            at = {i: new if r == old else r for i, r in at.items()}
        return at

    like = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if similarity(Counter(bags[x]), Counter(bags[y])) >= threshold]
    assert set(got) <= set(like) and groups(got) == groups(like) and len(got) < len(set(root.tolist()))
    assert len(got) == len(set(groups([]).values())) - len(set(groups(like).values())) < len(like)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = bagminhash.classes(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.class_size for r in by[5]] == [2, 2] and sum(r.keeper for r in by[5]) == 1
    assert by[7][0].class_id == by[8][0].class_id == 7 and by[8][0].links == 1
    assert by[1][0].class_size == 1 and by[1][0].keeper
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2  # the repeated row and the near copy; null texts stay
    assert bagminhash.classes(empty_documents(spark)).count() == 0
    assert bagminhash.keep_one(empty_documents(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (300, 200)]
    got = {r.node: r.root for r in bagminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[300] == 200
