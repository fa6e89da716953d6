import re

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, features string, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"),
        (5, "one two three four", "en", "b"), (5, "one two three four", "en", "b"), (None, "no id here at all", "en", "b"),
        (None, None, None, None), (7, long, "en", "c"), (8, long + " tail", "en", "c"), (9, "x" * 50_000, "fr", "c"),
        (10, "日本語 のテキスト 🙂🙂", None, None), (11, "### $$$ %%%", "de", "a"), (12, "a\n\na\nb\na", "en", ""),
    ]
    return spark.createDataFrame(
        [(i, t, la, s, None if t is None else len(t), 1, "d", "f", "s") for i, t, la, s in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
