"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are relative frequencies of letter trigrams (bytes of the lower-case text, everything but letters as a space), hashed
to ``DIMENSIONS`` places.  Each machine is a linear SVM with squared hinge loss, fitted on a bounded sample of
labelled documents; each document is judged on its whole text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_slices, text_buffers

DIMENSIONS = 1 << 12
#: At most this many labelled documents are fitted on, shared evenly among the languages.
SAMPLE_DOCUMENTS = 3000
UNKNOWN = "und"
#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for b in [*range(ord("a"), ord("z") + 1), *range(128, 256)]:
        table[b] = b
    return table


_TABLE = _letters()


def trigrams(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all trigrams of consecutive rows, and the row of each.  Rows begin and end with a space."""
    a = _TABLE[data[offsets[0]:offsets[-1]]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = a == 32
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    a, row = a[keep].astype(np.uint32), row[keep]
    if len(a) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    inside = row[2:] == row[:-2]
    place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(dimensions).bit_length() + 1)
    return place[inside].astype(np.int64), row[:-2][inside]


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def vectors(labelled: DataFrame, dimensions: int) -> DataFrame:
    """(lang, x): relative trigram frequencies as 16-bit floats, one row per document (lang, padded)."""
    def make(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for lo, hi in row_slices(offsets, 1 << 20):
                place, row = trigrams(data, offsets[lo:hi + 1], dimensions)
                x = np.bincount(row * dimensions + place, minlength=(hi - lo) * dimensions).reshape(hi - lo, dimensions)
                x = (100.0 * x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x])],
                                                 ["lang", "x"])

    return labelled.mapInArrow(make, "lang string, x binary")


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, y of -1 and 1, classes weighted evenly) by accelerated gradients."""
    scale = (1.0 / (x.std(0) + 0.05)).astype(np.float32)
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.multiply(x, scale, out=z[:, :-1])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(15):  # largest curvature
        v = z.T @ (share * (z @ v))
        bound = float(np.linalg.norm(v))
        v /= max(bound, 1e-12)
    rate = 1.0 / (2 * bound + penalty)
    w = step = np.zeros(z.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ step))
        new = step - rate * (penalty * step - 2 * (z.T @ (share * y * slack)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def fit(training: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE_DOCUMENTS) -> dict:
    """Model from rows (doc_id, text, lang) with a lang; languages, and the machine of each pair.

    Which documents are sampled depends on a hash of their doc_id, so reruns agree.
    """
    rows = training.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").collect()}
    if not sizes:
        return {"languages": [], "machines": {}}
    each = max(2, sample // len(sizes))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53))
    # a little more than needed; the rank below cuts to size
    shares = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, (each + 6 * each ** 0.5) / n))))
    share = F.try_element_at(shares, F.col("lang"))
    few = rows.withColumn("draw", draw).where(F.col("draw") < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", _padded(F.col("text")).alias("padded"))
    drawn = materialise(vectors(few, dimensions), "language-sample").orderBy("lang", "x").collect()
    langs = sorted({r["lang"] for r in drawn})
    of = np.array([langs.index(r["lang"]) for r in drawn])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in drawn), np.float16).reshape(len(drawn), dimensions).astype(np.float32)
    families = sorted({family_of(a) for a in langs})
    group = np.array([families.index(family_of(a)) for a in langs])[of]
    machines = {}
    for label, names, which in (("family", families, group), ("language", langs, of)):
        for i, j in combinations(range(len(names)), 2):
            if label == "language" and family_of(langs[i]) != family_of(langs[j]):
                continue
            mine = (which == i) | (which == j)
            machines[label, i, j] = fit_svm(x[mine], np.where(which[mine] == i, 1.0, -1.0).astype(np.float32))
    return {"languages": langs, "families": families, "machines": machines, "dimensions": dimensions}


def _vote(margins: dict[tuple[int, int], np.ndarray], n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner among ``n`` classes by one-versus-one votes (ties by summed margins), and its lowest chance."""
    if n == 1 or not rows:
        return np.zeros(rows, np.int64), np.ones(rows)
    votes, sums, low = np.zeros((rows, n)), np.zeros((rows, n)), np.ones((rows, n))
    for (i, j), m in margins.items():
        chance = 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        sums[:, i] += m
        sums[:, j] -= m
        low[:, i], low[:, j] = np.minimum(low[:, i], chance), np.minimum(low[:, j], 1 - chance)
    best = np.argmax(votes + 1e-3 * np.tanh(sums / (1 + np.abs(sums).max())), axis=1)
    return best, low[np.arange(rows), best]


def predict(docs: DataFrame, model: dict, keep: list[Column]) -> DataFrame:
    """``keep`` columns of each row of ``docs``, lang_pred and score, from the text alone.

    A text that is null or has no letter is ``und`` with score 0, as is all without a language learned.
    """
    rows = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
                       _padded(F.col("text")).alias("padded"))
    names = [c for c in rows.columns if c not in ("has_letter", "padded")]
    langs, machines = model["languages"], model["machines"]
    keys = list(machines)
    weights = np.stack([machines[k][0] for k in keys], axis=1) if keys else None
    bias = np.array([machines[k][1] for k in keys])
    dimensions = model.get("dimensions", DIMENSIONS)

    def judge(data, offsets):
        n = len(offsets) - 1
        margin = np.zeros((n, len(keys)))
        if keys:
            place, row = trigrams(data, offsets, dimensions)
            total = np.maximum(np.bincount(row, minlength=n), 1)
            for c in range(len(keys)):
                margin[:, c] = 100.0 * np.bincount(row, weights[place, c], n) / total + bias[c]
        at = {k: margin[:, c] for c, k in enumerate(keys)}
        families = model["families"]
        family, sure = _vote({k[1:]: m for k, m in at.items() if k[0] == "family"}, len(families), n)
        out, score = np.zeros(n, np.int64), np.zeros(n)
        for f, name in enumerate(families):
            members = [i for i, a in enumerate(langs) if family_of(a) == name]
            mine = family == f
            pairs = {(members.index(k[1]), members.index(k[2])): m[mine] for k, m in at.items()
                     if k[0] == "language" and k[1] in members}
            best, inner = _vote(pairs, len(members), int(mine.sum()))
            out[mine], score[mine] = np.array(members)[best], sure[mine] * inner
        return out, score

    def run(batches):
        for b in batches:
            has = b.column(len(names)).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(b.column(len(names) + 1))
            pred, score = np.zeros(len(has), np.int64), np.zeros(len(has))
            if langs:
                for lo, hi in row_slices(offsets, 1 << 21):
                    pred[lo:hi], score[lo:hi] = judge(data, offsets[lo:hi + 1])
            said = [langs[p] if langs and h else UNKNOWN for p, h in zip(pred, has, strict=True)]
            score = np.where(has & bool(langs), score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(said, pa.string()), pa.array(score)],
                                             [*names, "lang_pred", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: CRC-32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the documents that aren't held out, judge all.

    A null doc_id counts as learned from if its lang is known.  No documents, no rows.  Other columns are ignored.
    """
    doc = F.col("doc_id").cast("long")
    model = fit(docs.where(~held_out(doc)).select(doc.alias("doc_id"), "text", "lang"), **kw)
    return predict(docs, model, [doc.alias("doc_id"), held_out(doc).alias("held_out")])
