import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from ledgerlens.llm import periodic

from .helpers import SCHEMA, documents, empty_documents, odd_documents, words


def brute_runs(w):
    """Every lag, every maximal stretch; only stretches whose smallest period is the lag."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(brute_collapse(w, runs))))


def digests(docs):
    return periodic.run_digests(periodic.with_runs(periodic.with_planted_runs(docs)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_words(rng):
    """Words of small alphabets with repeats of repeats, broken at random."""
    w = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.randint(1, 12))]
    for _ in range(rng.randint(1, 3)):
        w = (w * rng.randint(1, 9))[:400] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice("abxy")
    return w


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(6):
        w = random_words(rng)
        got = periodic.runs_of_words([x.encode() for x in w])
        assert got == brute_runs(w), w
        assert [x.decode() for x in periodic.collapse([x.encode() for x in w], got)] == brute_collapse(w, got)


def test_edges_of_the_definition():
    runs = lambda s: periodic.runs_of_words(s.encode().split())
    assert runs("a " * 23) == [] and runs("a " * 24) == [(0, 24, 1)]
    nine = " ".join("abcdefghi")
    assert runs(f"{nine} {nine} {nine}"[:-2]) == [] and runs(f"x {nine} {nine} {nine} a b y") == [(1, 29, 9)]
    # two runs that overlap by less than a period, and one inside a period of another
    assert runs("a b " * 13 + "b a a " * 10) == brute_runs(("a b " * 13 + "b a a " * 10).split())
    inner = "z " * 30 + "u v "
    assert runs(inner * 3) == brute_runs((inner * 3).split())


def test_words_split_only_at_the_six_white_characters(spark):
    text = "a b\x85c\x1cd " * 30 + "\x0b\f\r\n\t"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = periodic.with_runs(docs).first()
    assert got.n_words == 30 and [tuple(r) for r in got.runs] == [(0, 30, 1)] and re.fullmatch("a b\x85c\x1cd", got.collapsed)


def test_query_on_the_documents(spark):
    docs = documents(spark).where("n_chars < 6000")
    got = rows(digests(docs))
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_documents(spark):
    docs = odd_documents(spark)
    short = docs.where("n_chars is null or n_chars < 60000")
    assert rows(digests(short)) == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=repr)
    assert digests(docs).count() == docs.count()
    assert digests(empty_documents(spark)).count() == 0


def test_very_long_texts(spark):
    phrase = " ".join(f"p{i}" for i in range(5000))
    texts = ["w " * 200_000, (phrase + " ") * 40, " ".join(f"q{i % 3}" if i % 1000 else f"break{i}" for i in range(100_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in periodic.with_runs(docs).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, 200_000, 1)] and got[0].collapsed == "w"
    assert [tuple(r) for r in got[1].runs] == [(0, 200_000, 5000)] and got[1].collapsed == phrase
    assert len(got[2].runs) == 100 and {r["period"] for r in got[2].runs} == {3}
