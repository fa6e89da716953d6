"""Best-fit packing by exact complements.

Documents become token pieces; sequences of ``capacity`` tokens are filled.
Lengths lie in 1..capacity, so the planner works on how many pieces each
length has, never on pieces: sums of one, two and three available lengths
are indexed, and each length takes combinations that fill its gap exactly,
as often as the counts allow.  What is left is packed best-fit decreasing.
The plan has at most ``capacity`` patterns, since each uses up a length; pieces find
their places by their rank within their length.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise

CAPACITY = 1024
END_ID = 2
#: Characters of a text that are tokenized at once; a longer stretch without a place to cut goes piece by piece.
STRETCH = 1 << 16


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def merge_ranks(path: str, letters: dict[int, str]) -> dict[bytes, int] | None:
    """Bytes and id of the tokens of a byte-level BPE file, if ids follow the order of merges, as rank files have it; else None.

    Then merging the neighbours whose union has the least id is merging by the list: the state of bytes between two
    boundaries that no merge crossed is the same in every text, so a token comes from one pair only.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    byte = {c: b for b, c in letters.items()}
    if any(y <= x for x, y in zip(ids, ids[1:], strict=False)) or len(ids) + len(letters) != len(model["vocab"]) or (
            ids and max(model["vocab"][c] for c in byte) > ids[0]) or model.get("ignore_merges"):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


class ByteTokenizer:
    """Ids of a ``tokenizers`` byte-level BPE as little-endian uint32 bytes.

    Texts go through the same vocabulary as merge ranks (``tiktoken``), in stretches cut before a single space between other
    characters, where no piece of the split pattern reaches across.  What has no such place within two stretches (the
    rank library's pattern search overflows on very long white space), and vocabularies that aren't in merge
    order, go through the file's own model piece by piece.
    """

    def __init__(self, path: str, pattern: str, stretch: int = STRETCH):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        # added tokens are found in the text before it is split; of those at one place the longest
        added = sorted(tokenizer.get_added_tokens_decoder().items(), key=lambda x: -len(x[1].content))
        self.added = [t.content for _, t in added]
        self.added_ids = [np.array([i], "<u4").tobytes() for i, _ in added]
        self.added_at = regex.compile("|".join(
            "(" + (r"\s*" if t.lstrip else "") + (r"(?<!\w)" if t.single_word else "") + regex.escape(t.content)
            + (r"(?!\w)" if t.single_word else "") + (r"\s*" if t.rstrip else "") + ")" for _, t in added))
        self.split = regex.compile(pattern).finditer
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.letters = _byte_letters()
        self.stretch = stretch
        ranks = merge_ranks(path, self.letters)
        self.ranked = ranks and tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self._between(text)
        out, at = [], 0
        for m in self.added_at.finditer(text):
            out += [self._between(text[at:m.start()]), self.added_ids[m.lastindex - 1]]
            at = m.end()
        return b"".join([*out, self._between(text[at:])])

    def _stretch(self, text: str) -> bytes:
        if self.ranked and len(text) <= 2 * self.stretch:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        out = []
        for m in self.split(text):
            word = m.group().encode("utf-8").decode("latin-1").translate(self.letters)
            out.append(np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes())
        return b"".join(out)

    def _between(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > self.stretch and (m := self.cut.search(text, at + self.stretch)):
            out.append(self._stretch(text[at:m.start()]))
            at = m.start()
        return b"".join([*out, self._stretch(text[at:])])


def token_pieces(docs: DataFrame, capacity: int, tokenizer_path: str | None, pattern: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, place): pieces with their token ids.

    ``part`` is the task and ``place`` the piece's rank among those of its length in that task; both are fixed once
    the table is written.  A document's first piece takes what its length leaves over, so all later ones are full.
    """
    if tokenizer_path is None or pattern is None:
        import public_tokenizers

        tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        pattern = pattern or public_tokenizers.PATTERN
    schema = "doc_id long, piece int, start long, length long, ids binary, part int, place long"

    def cut(batches):
        from pyspark import TaskContext

        tokenizer = ByteTokenizer(tokenizer_path, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        out, size = [], 0

        def batch():
            cols = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        names = ["doc_id", "piece", "start", "length", "ids", "part", "place"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    take = (n - at) % capacity or capacity
                    seen[take] += 1
                    out.append((doc, piece, at, take, ids[4 * at:4 * (at + take)], part, int(seen[take]) - 1))
                    at, piece, size = at + take, piece + 1, size + 4 * take
                    if size >= 1 << 23:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), schema)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use up ``counts`` (index: length)."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: list[int]) -> int:
        sizes, times = np.unique(pattern, return_counts=True)
        n = int((left[sizes] // times).min())
        if n:
            left[sizes] -= n * times
            out.append((tuple(pattern), n))
        return n

    def pair(total: int, also: tuple[int, ...]) -> tuple[int, int] | None:
        """Available a >= b with a + b = total, the largest a; ``also``: lengths that the pattern has already."""
        a = np.arange(min(total - 1, capacity), (total - 1) // 2, -1)
        a = a[(left[a] > 0) & (left[total - a] > 0)]
        for x in map(int, a):
            want = [*also, x, total - x]
            if all(left[s] >= want.count(s) for s in {x, total - x}):
                return x, total - x
        return None

    def exact(length: int) -> list[int] | None:
        gap = capacity - length
        if not gap:
            return [length]
        if left[gap] > (gap == length):
            return [length, gap]
        if two := pair(gap, (length,)):
            return [length, *two]
        sums = np.zeros(gap + 1, bool)  # index of the pair sums that are to be had
        have = np.flatnonzero(left[:gap])
        for a in have:
            sums[have[have + a <= gap] + a] = True
        for a in map(int, have[::-1]):
            if gap - a > 0 and sums[gap - a] and left[a] > (a == length) and (two := pair(gap - a, (length, a))):
                return [length, a, *two]
        return None

    for length in range(capacity, 0, -1):
        while left[length] and (pattern := exact(length)):
            if not use(pattern):
                break
    for length in range(capacity, 0, -1):  # best fit: the largest lengths that still go in
        while left[length]:
            pattern, gap, spare = [length], capacity - length, left.copy()
            spare[length] -= 1
            while gap and len(fits := np.flatnonzero(spare[:gap + 1])):
                pattern.append(int(fits[-1]))
                spare[fits[-1]] -= 1
                gap -= int(fits[-1])
            use(pattern)
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> pa.Table:
    """(length, first, until, sequence, offset): pieces of ``length`` with a rank from ``first`` to below ``until`` go to
    sequences from ``sequence`` on, one each, at ``offset``."""
    runs, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for s in lengths:
            runs.append((s, int(used[s]), int(used[s]) + times, sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    columns = zip(*runs, strict=True) if runs else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["of_length", "first", "until", "sequence", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None,
         pattern: str | None = None, digest: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns (doc_id, piece, start, length, ids, sequence_id, offset), ids as little-endian uint32 bytes; with
    ``digest`` ids_crc32, their CRC-32, stands in for ids, which then aren't shuffled.  A null or empty text is the
    end id alone; repeated rows are packed once each; a null doc_id stays null; no documents, no rows.  Other columns
    of ``docs`` are ignored.
    """
    pieces = materialise(token_pieces(docs, capacity, tokenizer_path, pattern), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)  # at most ``capacity`` rows
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    # at most ``capacity`` patterns of at most ``capacity`` pieces, whatever the number of documents
    runs = F.broadcast(docs.sparkSession.createDataFrame(places(plan(histogram, capacity), capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    ids = F.crc32("ids").alias("ids_crc32") if digest else F.col("ids")
    ranked = (pieces.select("doc_id", "piece", "start", "length", ids, "part", "place").join(base, ["part", "length"])
              .withColumn("rank", F.col("base") + F.col("place")))
    here = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    return ranked.join(runs, here).select(
        "doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
