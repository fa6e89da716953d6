"""Shared helpers: tables in the cluster's shared folder, word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only for a local master without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, below one folder per application, which may go when the application has ended."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and rows are fixed."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def lean(function):
    """A function of mapInArrow that returns freed memory to the system at its end: Python workers wait for later tasks with all
    that they ever held."""
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


# ----------------------------------------------------------------- hashing

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


#: Block length up to which powers are kept between blocks.
_POWERS = (1 << 18) + (1 << 14)


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The 1st to nth power of the base, and the 0th to (n - 1)th of its inverse."""
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(back)


def _words_of(block: np.ndarray, first: np.ndarray, n_before: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and start bytes of one block; ``first`` marks bytes where a row begins."""
    solid = ~_SPACE[block]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # words end before a space, before a row that begins, or with the block
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    end = np.flatnonzero(ends) + 1
    # sums of a word's bytes by powers from its start on, as differences of sums over the block
    power, back = _kept_powers() if len(block) <= _POWERS else _powers(len(block))
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:len(block)], out=sums[1:])
    sums = (sums[end] - sums[begin]) * back[begin]
    return mix64(sums ^ mix64((end - begin).astype(np.uint64))), begin + n_before


def hash_words(data: np.ndarray, offsets: np.ndarray, block_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive rows, and each row's first word as an index (length rows + 1).

    Bytes are taken in blocks cut at white space, so that the working set stays small for texts of any length.
    """
    lo, end, hashes, begins = int(offsets[0]), int(offsets[-1]), [], []
    row_starts = offsets[:-1]
    while lo < end:
        hi = min(end, lo + block_bytes)
        while hi < end:  # cut before a space, or where a row begins
            space = np.flatnonzero(_SPACE[data[hi:min(end, hi + 4096)]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(end, hi + 4096)
        first = np.zeros(hi - lo, bool)
        inside = row_starts[np.searchsorted(row_starts, lo):np.searchsorted(row_starts, hi)] - lo
        first[inside] = True
        h, b = _words_of(data[lo:hi], first, lo)
        hashes.append(h)
        begins.append(b)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(b, offsets)


def row_slices(offsets: np.ndarray, max_bytes: int = 1 << 20):
    """Ranges of rows of about ``max_bytes``; a longer row is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi
        lo = hi


def grams(words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the row of each.

    A row of 1 to k - 1 words has one gram of all its words; a row without words has none.
    """
    n = np.diff(first_word)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_word[:-1], count)
    size = np.minimum(n, k)[row]
    out = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        out = np.where(j < size, mix64(out * np.uint64(_BASE) + padded[at + j]), out)
    return out, row
