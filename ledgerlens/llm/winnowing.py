"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are runs of up to 16 non-space code points.  Every run of ``K`` tokens is hashed; of every ``W`` consecutive hashes
the smallest is kept, the rightmost of equal ones, with its position.  Two texts that share ``K + W - 1`` consecutive
tokens therefore share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

K = 4
W = 5
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Bits of a key that hold the position; the hash is above them, so the smallest key has the smallest hash and,
#: as positions are stored from the top down, the rightmost of equals.
POSITION_BITS = 27
_TOP = (1 << POSITION_BITS) - 1
HASH_BITS = 63 - POSITION_BITS


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Array of (hash, position) of a text, in order of position.

    A text of fewer than ``k`` tokens has one fingerprint of all its tokens; one with fewer than ``w`` hashes has their minimum; a
    text without tokens (empty, white space, null) has none.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)

    def keys(tok: Column) -> Column:
        n = F.size(tok)

        def key(i: Column) -> Column:
            h = F.xxhash64(*(F.get(tok, i + j) for j in range(k)))
            return F.shiftright(h, POSITION_BITS + 1) * F.lit(1 << POSITION_BITS) + (F.lit(_TOP) - i)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), key)
                      ).otherwise(F.array().cast("array<bigint>"))

    def minima(h: Column) -> Column:
        last = F.greatest(F.size(h) - w, F.lit(0))
        least = lambda i: F.least(*(F.get(h, i + j) for j in range(w)))  # noqa: E731  null places are passed over
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), least)).otherwise(h)

    def chosen(m: Column) -> Column:
        return F.filter(m, lambda v, j: (j == 0) | (v != F.get(m, j - 1)))

    picked = let(let(let(tokens, keys), minima), chosen)
    return F.transform(picked, lambda v: F.struct(
        F.shiftright(v, POSITION_BITS).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash"),
        (F.lit(_TOP) - v.bitwiseAND(F.lit(_TOP))).cast("int").alias("position")))


def as_string(prints: Column) -> Column:
    """position:hash of each fingerprint, separated by spaces."""
    return F.array_join(F.transform(prints, lambda p: F.concat(
        p["position"].cast("string"), F.lit(":"), F.lower(F.hex(p["hash"])))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes as sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def _cuts(ids: DataFrame, column: str, parts: int) -> list[int]:
    """About ``parts`` values of ``column``, the smallest first, that cut its rows into parts of like size."""
    shares = [i / parts for i in range(parts)]
    got = ids.agg(F.min(column).alias("lo"), F.percentile_approx(column, shares, 20 * parts).alias("cuts")).first()
    return sorted({got["lo"], *got["cuts"]}) if got["lo"] is not None else []


def _bucket(value: Column, cuts: list[int]) -> Column:
    """Place of the last cut not above ``value``: first among groups of cuts, then within one."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= value)) - 1
    group = upto(F.lit([g[0] for g in groups]))
    return group * step + upto(F.get(F.array(*(F.lit(g) for g in groups)), group))


def fingerprint_with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each document, of the next one by doc_id, and of the document with its tail replaced.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in ascending order of doc_id (null last, equal ids by text), the first following the last.  A
    null text is empty.  Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next); no documents, no rows; other columns of ``docs`` are ignored.

    Rows meet their successors in slices of the id range: a slice gets a copy of the next slice's first row, so one
    shuffle suffices and no task sees more than its slice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rank", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    cuts = _cuts(rows, "rank", 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not cuts:
        cuts = [0]
    bucket = _bucket(F.col("rank"), cuts)
    rows = rows.withColumn("bucket", bucket)
    starts = F.col("rank") == F.get(F.lit(cuts), F.col("bucket"))  # the first of a slice also ends the one before
    copy = F.struct(((F.col("bucket") + len(cuts) - 1) % len(cuts)).cast("int").alias("bucket"), F.lit(1).alias("ends"))
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("ends"))
    rows = rows.select("doc_id", "text", "rank", F.explode(
        F.when(starts, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc_id", "text", "rank", "at.bucket", "at.ends").repartition("bucket")
    rows = rows.withColumn("prints", winnow(F.col("text"), k, w))
    rows = rows.withColumn("hashes", F.array_distinct(F.transform("prints", lambda p: p["hash"])))
    following = F.lead(F.struct("text", "hashes")).over(Window.partitionBy("bucket").orderBy("ends", "rank", "text"))
    rows = rows.withColumn("next", following).where("ends = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_prints", winnow(F.col("edited"), k, w))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("prints")).alias("fingerprint"), as_string(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.transform("edited_prints", lambda p: p["hash"])).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next.hashes")).alias("near_next"))
