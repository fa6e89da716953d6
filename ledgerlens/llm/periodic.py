"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q (words q apart are equal) of at least ``LEAST`` words and ``POWERS``
periods.  Every word of a run occurs ``POWERS`` times or more in it, so a word that occurs less often in a segment is in no run
there: it splits the segment, and the parts are split again until no word is too rare.  What is left is scanned for lags.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

LEAST = 24
POWERS = 3
#: A run of period q matches itself q words on for this many words, seen from the first multiple of q inside it
#: (LEAST - 2q or POWERS * q - 2q words remain, whichever is more, less the q - 1 words before that multiple).
PROBE = 8
#: Bytes of text that are answered in one Arrow batch.
BATCH_BYTES = 4 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``ids`` in which each word occurs ``POWERS`` times or more and which have ``LEAST`` words or more."""
    open_, stable = [(0, len(ids))], []
    while open_:
        lo, hi = open_.pop()
        if hi - lo < LEAST:
            continue
        _, which, counts = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[which] < POWERS)
        if not len(rare):
            stable.append((lo, hi))
            continue
        begins = np.concatenate([[lo], lo + rare + 1])
        ends = np.concatenate([lo + rare, [hi]])
        wide = ends - begins >= LEAST
        open_ += zip(begins[wide].tolist(), ends[wide].tolist())
    return stable


def _gram_ids(ids: np.ndarray) -> np.ndarray:
    """Equal numbers for equal runs of ``PROBE`` words, by doubling."""
    grams, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while width < PROBE:
        left, right = grams[:-width], grams[width:]
        grams = np.unique(left * (int(grams.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return grams


def _probes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lags, places) at which the ``PROBE`` words from a multiple of the lag on recur a lag later, by lag and place.

    Short lags are scanned lag by lag over all their multiples, long ones multiple by multiple over all lags, so a segment of n words
    takes n log n comparisons in about 2 sqrt(n) array operations.
    """
    grams = _gram_ids(ids)
    n, longest = len(grams), len(ids) // POWERS
    lags, places = [], []
    short = min(longest, int(len(ids) ** 0.5) + 1)
    for q in range(1, short + 1):
        c = np.arange(0, n - q, q)
        c = c[grams[c] == grams[c + q]]
        places.append(c)
        lags.append(np.full(len(c), q, np.int64))
    j = 0
    while j * (short + 1) + short + 1 < n and short < longest:
        q = np.arange(short + 1, min(longest, (n - 1) // (j + 1)) + 1)
        q = q[grams[j * q] == grams[(j + 1) * q]]
        lags.append(q)
        places.append(j * q)
        j += 1
    lag, place = np.concatenate(lags).astype(np.int64), np.concatenate(places).astype(np.int64)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of ``a`` and ``b`` are equal."""
    done, step = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done:done + step] != b[done:done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return len(a)


def runs_of_segment(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside one segment.

    Probes are followed from the shortest lag on.  Inside a known run of period q, a lag that is a multiple of q, or of which two
    periods lie in the run, has no smallest period of its own (Fine and Wilf), so those probes are done.
    """
    lag, place = _probes(ids)
    found = []
    while len(lag):
        q, at = int(lag[0]), int(place[0])
        end = at + q + _reach(ids[at:-q], ids[at + q:])
        start = at - _reach(ids[:at][::-1], ids[q:at + q][::-1])
        open_ = (lag != q) | (place < start) | (place >= end - q)
        if end - start >= max(LEAST, POWERS * q) and not any(s <= start and end <= s + n for s, n, _ in found):
            found.append((start, end - start, q))
            inside = (place >= start) & ((place + 2 * lag <= end) | ((lag % q == 0) & (place + lag <= end)))
            open_ &= ~inside
        lag, place = lag[open_], place[open_]
    return found


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < LEAST:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < LEAST - LEAST // POWERS:  # a run repeats two thirds of its words
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted((lo + s, n, q) for lo, hi in segments(ids) for s, n, q in runs_of_segment(ids[lo:hi]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run has behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def with_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of each row with its n_words, runs (start, length, period in words, by start, then period) and collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  The collapsed text has the words that no run contains behind its first period, joined by one space.
    Null, empty and white texts have no words, no runs and an empty collapsed text.  Texts are taken whole; the work grows as
    n log n with a text.  Repeated rows are answered each; other columns of ``docs`` are ignored; no documents, no rows.
    """
    kept = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    at = len(keep)

    def answer(batches):
        for b in batches:
            texts = b.column(at).cast(pa.large_binary())
            lo, n = 0, b.num_rows
            while lo < n:
                size, hi, out = 0, lo, ([], [], [])
                while hi < n and size < BATCH_BYTES:
                    raw = texts[hi].as_py()
                    words = raw.split()  # bytes are split at exactly the six white characters
                    runs = runs_of_words(words)
                    out[0].append(len(words))
                    out[1].append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                    out[2].append(b" ".join(collapse(words, runs)).decode())
                    size, hi = size + len(raw), hi + 1
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(at)), pa.array(out[0], pa.int64()),
                     pa.array(out[1], pa.list_(RUN)), pa.array(out[2], pa.string())],
                    [*keep, "n_words", "runs", "collapsed"])
                lo = hi

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:at])
    return kept.mapInArrow(answer, f"{kinds}, {RUNS_SCHEMA}")


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a periodic tail in about every tenth text.

    With h the CRC of the decimal id and g = h div 10, a text of n > 0 words with h mod 10 = 0 goes on from word a = g mod n with period
    1 + (n - a) div (3 + g mod 8) of its own words.  Rows without an id stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), 0)

    def tail(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, source(i).cast("int"))), " "))

    planted = F.when(h % 10 == 0, let(words, tail))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(planted, F.col(text)).alias("text"))


def strongest(runs):
    """The run of the greatest exact length / period; ties go to the smallest start, then the smallest period."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`with_runs`: the strongest run, a hash of all runs and a hash of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
