import hashlib

from pyspark.sql import functions as F

from ledgerlens.llm import winnowing

from .helpers import SCHEMA, documents, empty_documents, odd_documents


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        yield i, len(t), t[:len(t) - len(t) // 2] + n[:len(t) // 2]


def check(spark, docs):
    want = sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in brute_edits(
        [(r.doc_id, r.text) for r in docs.collect()])), key=repr)
    rows = winnowing.fingerprint_with_edits(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    return rows


def test_next_document_and_edits(spark):
    rows = check(spark, documents(spark))
    far = sum(r.near_next for r in rows) / len(rows)
    assert sum(r.near_edited for r in rows) / len(rows) > far + 0.2


def test_odd_documents(spark):
    rows = check(spark, odd_documents(spark))
    same = {r.fingerprint for r in rows if r.doc_id == 5}
    assert len(same) == 1 and "" not in same
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(3, "a b c d e f", "en", "s", 11, 1, "", "", "")], SCHEMA)
    assert check(spark, one)[0].edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert winnowing.fingerprint_with_edits(empty_documents(spark)).count() == 0


def test_selection_against_brute_force_with_rightmost_ties(spark):
    text = "a b c d a b c d a b c d x y z a b c d q r s t u v w a b c d"
    k, w = 4, 5
    tok = text.split(" ")
    grams = [tuple(tok[i:i + k]) for i in range(len(tok) - k + 1)]
    hashed = {r.g: r.h >> (winnowing.POSITION_BITS + 1) for r in spark.createDataFrame([("|".join(g),) for g in set(grams)], "g string").select(
        "g", F.xxhash64(*(F.split("g", r"\|")[j] for j in range(k))).alias("h")).collect()}
    h = [hashed["|".join(g)] for g in grams]
    want = sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)})
    got = spark.createDataFrame([(text,)], "t string").select(winnowing.winnow(F.col("t"), k, w).alias("p")).first().p
    assert [p.position for p in got] == want
    # shared stretches of k + w - 1 tokens share a fingerprint
    other = "m n o p " + " ".join(tok[12:12 + k + w - 1]) + " k l m"
    two = spark.createDataFrame([(other,)], "t string").select(winnowing.winnow(F.col("t"), k, w).alias("p")).first().p
    assert {p.hash for p in got} & {p.hash for p in two}
