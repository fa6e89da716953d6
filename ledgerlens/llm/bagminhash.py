"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

A text is a multiset of word shingles, weighted by how often each occurs.  Each (shingle, level of weight) has a Poisson
process over time whose points fall on random components; a signature component is the earliest time of a point on
it among all levels that the text's weights reach, so two texts agree on a component with the probability of their
weighted Jaccard similarity.  Levels are not visited one by one: they hang in a dyadic hierarchy (level 0, 1, 2-3,
4-7, ...), a node has one process with the rate of all its levels, and a point belongs to one level of the node
at random.  Processes stop once their time exceeds the largest component so far.

Texts are banded; in each band all texts of a bucket are compared with the bucket's smallest one.  In a bucket whose texts
then lie in several classes, all texts of different classes are compared inside tasks, each pair in the first bucket that it
shares.  Buckets are cut to squares of at most ``SIDE`` by ``SIDE`` texts, so large ones spread over tasks.  The shingle
multisets of texts that have a partner by signature travel to their squares, and a square gives only the links that
join two of its classes, the likeliest pairs tried first: fewer rows than it has texts, whatever the pairs.

Of each pair, the signatures' agreement rules out what lies five standard deviations below the threshold; the rest is
compared exactly, on the whole shingle multisets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, grams, hash_words, lean, materialise, mix64, row_slices, text_buffers, unique_name

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
SEED = 0x5DEECE66D
#: Texts on each side of a square of a bucket, and their shingles.
SIDE = 1024
SIDE_SHINGLES = 1 << 20
#: Shingles that are looked up at once when pairs of a square are compared.
LOOKUPS = 1 << 20
#: Texts with fewer distinct shingles than this are signed together, many at a time.
FEW = 24

_U53 = 1.0 / (1 << 53)
_GOLD = 0x9E3779B97F4A7C15


def counted(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, gram) and how often each occurs, in order of row."""
    order = np.lexsort((gram, row))
    g, r = gram[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))) if len(g) else np.zeros(0, int)
    return g[first], r[first], np.diff(np.append(first, len(g)))


def signatures(gram: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int, seed: int = SEED) -> np.ndarray:
    """BagMinHash signatures (rows x m) of multisets: elements ``gram`` of ``row`` with integer ``weight`` of 1 or more."""
    sig = np.full(rows * m, np.inf)
    # nodes of the hierarchy that a weight reaches: 0 has level 0, j has the levels from 2^(j-1) to 2^j - 1
    nodes = np.ceil(np.log2(weight)).astype(np.int64) + 1
    who = np.repeat(np.arange(len(gram)), nodes)
    node = np.arange(len(who)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    low = np.where(node > 0, 1 << np.maximum(node - 1, 0), 0)
    width = np.maximum(low, 1)
    state = mix64(gram[who] ^ mix64(node.astype(np.uint64) + np.uint64(seed)))
    at, need, time = row[who], weight[who], np.zeros(len(who))
    limit = np.full(rows, np.inf)
    step = 0
    while len(at):
        step += 1
        state = mix64(state + np.uint64(_GOLD))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * _U53) / width
        alive = time <= limit[at]
        if not alive.all():
            at, need, time, state, low, width = (x[alive] for x in (at, need, time, state, low, width))
        if not len(at):
            break
        extra = mix64(state ^ np.uint64(0xD1B54A32D192ED03))
        place = at * m + (extra % np.uint64(m)).astype(np.int64)
        level = low + (((extra >> np.uint64(40)).astype(np.int64) * width) >> 24)
        hit = level < need
        np.minimum.at(sig, place[hit], time[hit])
        if step < 8 or step % 8 == 0:
            some = np.unique(at)
            limit[some] = sig.reshape(rows, m)[some].max(axis=1)
    return sig.reshape(rows, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band (n x bands) of ``rows`` components each."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
    for j in range(rows):
        out = mix64(out * np.uint64(_GOLD) + bits[:, :, j])
    return out


def _sign(keyed: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(all columns of ``keyed`` but text, n_shingles, bands, sketch): the latter are null for a text without words.

    sketch is a byte of each signature component.
    """
    m = bands * rows
    names = [c for c in keyed.columns if c != "text"]

    def sign(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
            n = len(offsets) - 1
            total, hashes, small = np.zeros(n, np.int64), np.zeros((n, bands), np.uint64), []
            sketch = np.zeros((n, m), np.uint8)

            def put(gram, row, weight):
                there, dense = np.unique(row, return_inverse=True)
                sig = signatures(gram, dense, weight, len(there), m)
                hashes[there] = bands_of(sig, bands, rows)
                sketch[there] = mix64(sig.view(np.uint64)).astype(np.uint8)

            for lo, hi in row_slices(offsets, 1 << 21):
                words, first = hash_words(data, offsets[lo:hi + 1])
                gram, row = grams(words, first, k)
                total[lo:hi] = np.bincount(row, minlength=hi - lo)
                gram, row, weight = counted(gram, row)
                few = np.bincount(row, minlength=hi - lo)[row] < FEW
                small.append((gram[few], row[few] + lo, weight[few]))
                put(gram[~few], row[~few] + lo, weight[~few])
            put(*(np.concatenate(x) for x in zip(*small, strict=True)) if small else ())
            some = pa.array(total > 0)
            flat = pa.array(hashes.view(np.int64).reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), flat)
            listed = pc.if_else(some, listed, pa.scalar(None, listed.type))
            short = pc.if_else(some, pa.array([r.tobytes() for r in sketch], pa.binary()), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(total), listed, short],
                                             [*names, "n_shingles", "bands", "sketch"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")
    return keyed.mapInArrow(lean(sign), f"{schema}, n_shingles long, bands array<long>, sketch binary")


def _least(threshold: float, m: int) -> float:
    """Components of ``m`` that agree at least, but for five standard deviations, at a similarity of ``threshold``."""
    return m * threshold - 5 * (m * threshold * (1 - threshold)) ** 0.5


def _plausible(pairs: DataFrame, threshold: float, m: int) -> DataFrame:
    """Of ``pairs`` (a, b, and their sketches sa, sb), (a, b) of those that don't rule out a similarity of ``threshold``."""
    least = _least(threshold, m)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, m) for c in (2, 3))
                yield batch.filter(pa.array((sa == sb).sum(1) >= least)).select([0, 1])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(lean(keep), "a long, b long")


def _alike(cell: np.ndarray, h: np.ndarray, side: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray,
           bands: np.ndarray, threshold: float, least: float):
    """(first, second, agreement) of the pairs of rows of equal ``cell`` (in order) that have unlike roots, sizes within
    ``threshold``, ``least`` equal components and bucket ``h`` as the first that they share, a part of the pairs at a time;
    side: 0 and 1 are compared with each other only, 2 with all."""
    at, lag = np.arange(len(cell)), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(cell)]
        at = at[cell[at] == cell[at + lag]]
        to = at + lag
        good = (root[at] != root[to]) & ((side[at] != side[to]) | (side[at] == 2))
        good &= np.minimum(size[at], size[to]) >= threshold * np.maximum(size[at], size[to])
        a, b = at[good], to[good]
        same = (sketch[a] == sketch[b]).sum(1)
        good = same >= least
        a, b, same = a[good], b[good], same[good]
        shared = bands[a, np.argmax(bands[a] == bands[b], axis=1)] == h[a]
        if shared.any():
            yield a[shared].astype(np.int32), b[shared].astype(np.int32), same[shared].astype(np.int32)


def joining(a: np.ndarray, b: np.ndarray, same: np.ndarray, root: np.ndarray, grams_of: list[np.ndarray],
            weights_of: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Of the pairs (a, b) of rows, links of similarity ``threshold`` or more that connect all classes (``root``) that such
    links connect, one less than these at most; pairs are tried by agreement ``same``."""
    sizes = np.array([len(g) for g in grams_of])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    weight = np.concatenate(weights_of).astype(np.int64)
    total = np.add.reduceat(weight, begin[:-1])
    # one sorted list of (row, number of the gram among the grams of all rows)
    code = np.unique(np.concatenate(grams_of), return_inverse=True)[1].astype(np.int64)
    key = (np.repeat(np.arange(len(sizes)), sizes) << 40) | code
    class_of = np.unique(root, return_inverse=True)[1]
    leader = np.arange(class_of.max() + 1)
    order = np.lexsort((b, a, -same))
    out, at, step = [], 0, 64
    while at < len(order):
        some = order[at:at + step]
        at, step = at + step, min(2 * step, 1 << 14)
        x, y = a[some], b[some]
        apart = leader[class_of[x]] != leader[class_of[y]]
        x, y = x[apart], y[apart]
        cuts = np.searchsorted(np.cumsum(sizes[x]), np.arange(LOOKUPS, int(sizes[x].sum()), LOOKUPS)) + 1
        for xs, ys in zip(np.split(x, cuts), np.split(y, cuts), strict=True):
            pair = np.repeat(np.arange(len(xs)), sizes[xs])
            mine = np.arange(len(pair)) + np.repeat(begin[xs] - np.cumsum(sizes[xs]) + sizes[xs], sizes[xs])
            wanted = (ys.astype(np.int64)[pair] << 40) | code[mine]
            there = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            shared = np.bincount(pair, np.where(key[there] == wanted, np.minimum(weight[mine], weight[there]), 0), len(xs))
            good = shared >= threshold * (total[xs] + total[ys] - shared)
            for i, j in zip(xs[good].tolist(), ys[good].tolist(), strict=True):
                one, two = leader[class_of[i]], leader[class_of[j]]
                if one != two:
                    leader[leader == two] = one
                    out.append((i, j))
    return out


def _by_square(batches):
    """Batches of whole squares: rows come sorted by h, i, j, the first three columns."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        h, i, j = (rest.column(c).to_numpy() for c in range(3))
        last = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        if len(last):  # the last square may go on in the next batch
            yield rest.slice(0, last[-1] + 1)
            rest = rest.slice(last[-1] + 1)
    if rest is not None and rest.num_rows:
        yield rest


def _square_columns(t: pa.Table, m: int, bands: int):
    """(cell, h, side, nid, root, n_shingles, sketch, bands) of rows of squares as arrays; cell numbers the squares."""
    h, i, j, side, nid, root, size = (t.column(c).to_numpy() for c in range(7))
    sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, m)
    hashes = t.column(8).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, bands)
    cell = np.cumsum(np.concatenate(([True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    return cell, h, side, nid, root, size, sketch, hashes


def _bags(nids: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(nid, gram, weight): the shingle multisets of texts, sorted 8-byte hashes and 4-byte counts."""
    def count(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for lo, hi in row_slices(offsets, 1 << 21):
                gram, row, weight = counted(*grams(*hash_words(data, offsets[lo:hi + 1]), k))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                weight = weight.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo),
                    *(pa.array([v[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for v in (gram, weight))],
                    ["nid", "gram", "weight"])

    return _texts(nids, reps, docs).mapInArrow(lean(count), "nid long, gram binary, weight binary")


def _across(buckets: DataFrame, root: DataFrame, reps: DataFrame, docs: DataFrame, k: int, threshold: float, bands: int,
            rows: int) -> DataFrame:
    """Links (a, b) of similarity ``threshold`` or more between texts of one bucket but of different classes: all classes that
    such links connect are connected.

    ``buckets``: (h, nid, n_shingles); root: (node, root), texts without a row are classes of their own; reps: (nid,
    n_shingles, sketch, bands, digest).
    """
    m = bands * rows
    classed = buckets.select("h", "nid", "n_shingles").join(root.withColumnRenamed("node", "nid"), "nid", "left").withColumn(
        "root", F.coalesce("root", "nid"))
    mixed = classed.groupBy("h").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("all")).where(
        "low <> high").select("h", F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("all") / SIDE_SHINGLES)).cast("int").alias("parts"))
    part, other = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"), F.col("other")
    dealt = classed.join(mixed, "h").join(reps.select("nid", "sketch", "bands"), "nid").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["h", "i", "j", "side", "nid", "root", "n_shingles", "sketch", "bands"]
    cells = dealt.withColumns({
        "i": F.least("part", other), "j": F.greatest("part", other),
        "side": F.when(F.col("part") == other, 2).otherwise((F.col("part") > other).cast("int"))}).select(*names)
    cells = cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    least = _least(threshold, m)

    def hopeful(batches):  # rows that have a partner
        for t in _by_square(batches):
            cell, h, side, _, root, size, sketch, hashes = _square_columns(t, m, bands)
            some = np.zeros(len(cell), bool)
            for a, b, _ in _alike(cell, h, side, root, size, sketch, hashes, threshold, least):
                some[a] = some[b] = True
            yield from t.filter(pa.array(some)).to_batches()

    def links(batches):
        for t in _by_square(batches):
            cell, *_ = _square_columns(t, m, bands)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                square = t.slice(lo, hi - lo)
                cell_, h, side, nid, root, size, sketch, hashes = _square_columns(square, m, bands)
                found = list(_alike(cell_, h, side, root, size, sketch, hashes, threshold, least))
                if not found:
                    continue
                gram, weight = ([np.frombuffer(x.as_buffer(), kind) for x in square.column(c)] for c, kind in ((9, np.uint64), (10, np.uint32)))
                got = joining(*(np.concatenate(x) for x in zip(*found, strict=True)), root, gram, weight, threshold)
                if got:
                    a, b = (nid[list(x)] for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    schema = "h long, i int, j int, side int, nid long, root long, n_shingles long, sketch binary, bands array<long>"
    cells = materialise(cells.mapInArrow(lean(hopeful), schema), "squares")
    if not cells.limit(1).count():
        return cells.select(F.col("nid").alias("a"), F.col("nid").alias("b"))
    bags = materialise(_bags(cells.select("nid").distinct(), reps, docs, k), "bags")
    full = cells.join(bags, "nid").select(*names, "gram", "weight").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return full.mapInArrow(lean(links), "a long, b long")


def _overlap(pairs: DataFrame, k: int) -> DataFrame:
    """Exact weighted Jaccard similarity of the texts of each row's a_text and b_text: (a, b, similarity)."""
    def compare(batches):
        for b in batches:
            da, oa = text_buffers(b.column(2))
            db, ob = text_buffers(b.column(3))
            n = len(oa) - 1
            out = np.zeros(n)
            for lo, hi in row_slices(oa + ob - ob[0], 1 << 21):
                sides = [counted(*grams(*hash_words(d, o[lo:hi + 1]), k)) for d, o in ((da, oa), (db, ob))]
                gram, row, w = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((gram, row))
                gram, row, w = gram[order], row[order], w[order]
                same = np.flatnonzero((gram[1:] == gram[:-1]) & (row[1:] == row[:-1]))
                shared = np.bincount(row[same], np.minimum(w[same], w[same + 1]), hi - lo)
                every = np.bincount(row, w, hi - lo)
                out[lo:hi] = shared / np.maximum(every - shared, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["a", "b", "similarity"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(lean(compare), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, from undirected edges (a, b).

    Labels spread along the edges and jump to their label's label, until nothing changes; each round is written to the
    shared folder.  Only a count of changes comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
                      .withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = now.join(near, now["node"] == near["a"]).select("node", F.col("root").alias("old"),
                                                              F.least("root", "near").alias("root"))
        jump = new.select(F.col("node").alias("of"), F.col("root").alias("further"))
        new = materialise(new.join(jump, new["root"] == jump["of"], "left").select(
            "node", "old", F.least(F.col("root"), F.coalesce("further", "root")).alias("root")), "labels")
        changed = new.where("old <> root").limit(1).count()
        discard(now)
        now = new.select("node", "root")
        if not changed:
            discard(both)
            return now


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS,
            rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, copies, links, keeper, digest) for each row of ``docs`` (doc_id, text).

    Equal texts are one class; so are texts with a weighted Jaccard similarity of their ``k``-word shingles of
    ``threshold`` or more, and whatever such links connect.  class_id is the smallest doc_id of the class (null only if all
    are), class_size its rows, copies the rows with this very text, links the verified links of this text to
    others, of which those that join no classes are not looked for.  ``keeper`` marks one row per class, that of the smallest doc_id; digest is the SHA-256 of the text.
    A null text is a class of its own per row.  A text of fewer than ``k`` words is one shingle; without words,
    only equal texts match.  Other columns are ignored; no documents, no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("digest", text_digest(F.col("text")))
    signed = materialise(_sign(keyed, k, bands, rows).withColumn("nid", F.monotonically_increasing_id()), "signed")
    # copies first: one text of each, whatever their number
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), "nid")
    texts = materialise(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("copies")).select(
        "digest", F.col("first.nid").alias("rep"), F.col("first.rank").alias("rank"), "copies"), "texts")
    reps = materialise(signed.select("nid", "n_shingles", "bands", "sketch").where("bands IS NOT NULL").join(
        texts.select(F.col("rep").alias("nid"), "digest"), "nid"), "reps")
    banded = reps.select("nid", "n_shingles", F.explode("bands").alias("h"))
    heads = banded.groupBy("h").agg(F.min("nid").alias("head"), F.count("*").alias("n")).where("n > 1").select("h", "head")
    like = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    sketches = reps.select("nid", "sketch")
    buckets = materialise(banded.join(heads, "h").join(sketches, "nid"), "buckets")  # of two texts or more
    of_head = reps.select(F.col("nid").alias("head"), F.col("n_shingles").alias("of_head"), F.col("sketch").alias("sa"))
    spokes = buckets.where("nid <> head").select("nid", "head", "n_shingles", "sketch").distinct().join(of_head, "head")
    pairs = spokes.where(like("n_shingles", "of_head")).select(
        F.col("head").alias("a"), F.col("nid").alias("b"), "sa", F.col("sketch").alias("sb"))
    tried = materialise(_plausible(pairs, threshold, bands * rows), "pairs")
    links = materialise(_similar(tried, reps, docs, k).where(F.col("similarity") >= threshold), "links")
    root = components(links)
    found = materialise(_across(buckets, root, reps, docs, k, threshold, bands, rows), "links")
    if found.limit(1).count():
        links = materialise(links.select("a", "b").union(found).distinct(), "links")
        root = components(links)
    degree = links.select("a", "b").union(links.select("b", "a")).groupBy("a").agg(F.count("*").alias("links"))
    members = (texts.join(root, texts["rep"] == root["node"], "left").join(degree, texts["rep"] == degree["a"], "left")
               .select("digest", "rep", "rank", "copies", F.coalesce("root", "rep").alias("root"),
                       F.coalesce("links", F.lit(0)).alias("links")))
    sizes = members.groupBy("root").agg(F.min(F.struct("rank", "rep")).alias("first"), F.sum("copies").alias("class_size"))
    texts_out = members.join(sizes, "root").select(
        "digest", "copies", "links", "class_size", F.col("first.rank").alias("class_rank"), F.col("first.rep").alias("keep"))
    out = signed.select("doc_id", "digest", "nid").join(texts_out, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.nullif("class_rank", F.lit((1 << 63) - 1))).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (alone | (F.col("nid") == F.col("keep"))).alias("keeper"), "digest")


def _texts(nids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(nid, text) of distinct ``nids``."""
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("digest", text_digest(F.col("text")))
    # copies go before the shuffle: a task sends one text of each digest
    texts = texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("text").alias("text"))
    return nids.join(reps.select("nid", "digest"), "nid").join(texts, "digest").select("nid", "text")


def _similar(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact similarity of the texts of distinct pairs (a, b): (a, b, similarity)."""
    if not pairs.limit(1).count():
        return pairs.withColumn("similarity", F.lit(0.0))
    texts = materialise(_texts(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct(), reps, docs), "texts")
    with_a = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("a_text")), "a")
    with_b = with_a.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("b_text")), "b")
    return _overlap(with_b, k)


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row that :func:`classes` keeps, with its columns.

    Rows that agree in doc_id and text but differ elsewhere count as copies; one of them stays.  Rows with a null text
    stay.
    """
    digest, key = unique_name(docs, "digest"), unique_name(docs, "key")
    kept = classes(docs, **kw).where("keeper AND digest IS NOT NULL").select(
        F.xxhash64("digest", F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()).alias(key))
    rows = docs.withColumn(digest, text_digest(F.col("text").cast("string")))
    null = rows.where(F.col(digest).isNull()).drop(digest)
    doc = F.col("doc_id").cast("long")
    rows = rows.withColumn(key, F.xxhash64(digest, F.coalesce(doc, F.lit(-1)), doc.isNull())).join(kept, key, "left_semi")
    return rows.dropDuplicates([key]).select(*docs.columns).unionByName(null.select(*docs.columns))
