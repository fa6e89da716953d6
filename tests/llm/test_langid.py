import zlib

from pyspark.sql import functions as F

from ledgerlens.llm import langid

from .helpers import documents, empty_documents, odd_documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs = documents(spark)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(map(tuple, langid.identify(d).collect())) for d in (docs, other))
    assert a == b


def test_three_languages_of_one_family_and_a_lonely_one(spark):
    words = {"es": "perro gato casa cielo", "fr": "chien maison oiseau bleu", "it": "cane gatto cielo bella", "fi": "koira kissa talo"}
    rows = [(100 * n + i, " ".join(w.split()[i % 3:] * (1 + i % 5)), la) for n, (la, w) in enumerate(words.items()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id): r.lang_pred for r in langid.predict(docs, langid.fit(docs), [F.concat("lang", "doc_id").alias("doc_id")]).collect()}
    assert all(k.startswith(v) for k, v in got.items())


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    assert len(langid.identify(docs).collect()) == docs.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 11))
    assert langid.identify(empty_documents(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More than a hundred labels, the last with fewer documents than the others."""
    langs = [f"{base}-{i}" for base in ("en", "es", "pl") for i in range(37)]
    rows = [(100 * n + i, f"k{n} word{n} and{n}", la) for n, la in enumerate(langs) for i in range(2 if n == 110 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, 64, 222)["languages"] == sorted(langs)
