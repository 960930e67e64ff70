"""Helpers shared by the corpus operators.

Text kernels work on the raw UTF-8 buffers of Arrow arrays, in pieces of about
``PIECE_BYTES``, so that a Python worker's memory does not follow the size of
an Arrow batch. A single longer text is its own piece.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PIECE_BYTES = 1 << 20
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a new temporary one where that is unset, which only a local master can do with."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base else "file://" + base.removeprefix("file:")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own in the shared folder; writers create it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans whose results have been written: its cleaner waits until the driver collects garbage, and meanwhile a long job's dead files fill the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` through the shared folder; shuffle files of what led to it go."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    release(spark)
    return spark.read.parquet(folder)


def numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and a struct of two longs without nulls that tells its rows apart and stays the same whenever they are read: where a row stands in its file. Rows that are not from files are written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    except AnalysisException:
        own = f"_{uuid.uuid4().hex}"
        docs = cut(docs.withColumn(own, F.monotonically_increasing_id()))
        file, row = F.lit(0).cast("bigint"), F.col(own)
    return docs, F.struct(file.alias("file"), row.alias("row"))


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound what goes to Python workers at once: texts may be long, so Spark's default of 10,000 rows a batch is too many. Smaller settings stay. The session keeps the bounds, as plans are run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) of an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``size`` bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes for which ``inside[byte]``, and the row that it is in."""
    flag = inside[data]
    before = np.zeros(len(flag), bool)
    before[1:] = flag[:-1]
    after = np.zeros(len(flag), bool)
    after[:-1] = flag[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(flag))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(flag & ~before)
    end = np.flatnonzero(flag & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def byte_classes(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Table of the bytes outside the given closed ranges."""
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = byte_classes([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordHasher:
    """64-bit hashes of byte spans, through prefix sums of a polynomial over random byte values.

    The polynomial's base is odd, so dividing by its powers is exact modulo 2**64;
    each hash is finished with its length and a mixer.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(0, 1 << 62)) * 4 + 3) & _MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    step = np.uint64(pow(base, len(p), 1 << 64))
                    p = np.concatenate([p, p * step])
                setattr(self, name, p[:n])

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * np.uint64(_GOLD))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row (of all its words if it has fewer), and their number by row.

    words: word hashes, row after row; counts: words by row.
    """
    n, first = len(words), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out_counts = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), out_counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(out_counts) - out_counts, out_counts) + first[row]
    length = np.minimum(counts[row], k)
    h = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        within = j < length
        nxt = words[np.minimum(at + j, max(n - 1, 0))] if n else np.zeros(0, np.uint64)
        h = np.where(within, mix(h * np.uint64(3) + nxt), h)
    return h, out_counts


def distinct_by_row(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and their number."""
    parts, sizes, a = [], np.zeros(len(counts), np.int64), 0
    for i, c in enumerate(counts.tolist()):
        if c:
            x = np.sort(h[a : a + c])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])] if c > 1 else x
            parts.append(x)
            sizes[i] = len(x)
            a += c
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def row_sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64 for unsigned values) of ``counts`` consecutive values each."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
