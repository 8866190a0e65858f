"""Shared pieces of the corpus operators: shared storage, Arrow text access, word splitting and hashing.

Texts stay Arrow buffers; numpy works on their UTF-8 bytes. A word is a run of bytes other than
0x20 and 0x09-0x0D, which on UTF-8 is exactly ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers share an executor's memory with its JVM: what Arrow frees goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh local one where unset (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.conf.get("spark.loglake.shared.dir", None)
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="loglake-")
        spark.conf.set("spark.loglake.shared.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loglake-{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's garbage does; asking for that keeps what finished steps leave on disks small."""
    gc.collect()
    spark._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Deletes tables of :func:`written` once nothing lazy reads them any more."""
    jvm, hconf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/loglake-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(hconf).delete(path, True)
    release(df.sparkSession)


# ---------------------------------------------------------------- Arrow access


#: Rows that reach a Python worker at once at most; texts may be long.
BATCH_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by ``BATCH_ROWS``: neither side then holds many long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n, as the split of rows into learnt and held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, at most ``most`` bytes unless one row has more.

    Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one entry more than rows)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~BREAK[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any span of a sequence, from prefix sums modulo 2**64 with an odd base."""

    def __init__(self, seed: int) -> None:
        rule = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.base = int(rule[256]) | 1
        self.letters = rule[:256]
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 16, len(self.up) * 3 // 2)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes (through a table of random values) or over 64-bit values."""
        n = len(values)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.letters[values] if values.dtype == np.uint8 else values) * self.up[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(sums))
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The hash of every span of length k."""
        n = len(sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(sums))
        return mix((sums[k:] - sums[:-k]) * self.down[:n])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the index of each row's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the spans, in order."""
    return np.arange(int(length.sum())) + np.repeat(starts - (np.cumsum(length) - length), length)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by block prefix and suffix minima."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    filled = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    back = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in a span."""
    delta = np.bincount(starts, minlength=length + 1) - np.bincount(ends, minlength=length + 1)
    return np.cumsum(delta[:length]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
