"""Shared helpers: table access, written intermediates, UTF-8 word spans and
hashes on Arrow text buffers, and range numbers for sorted writers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.session import scratch_path

#: Bytes of text that a task turns into NumPy arrays at a time (one longer text is taken alone).
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut, later reads prune columns, and a lost executor
    costs a reread at most."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_memory() -> None:
    """Let the C library give arrays of a megabyte and more back when they are
    freed, instead of keeping them for later ones."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, not grown with use
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def release_memory() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and
    what one stage has freed should not count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ------------------------------------------------------------ text buffers
def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a NULL is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset:col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0]:o[-1]], o - o[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [a, b) whose texts have about ``limit`` bytes together."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


def separator_table(separators: bytes | list[int]) -> np.ndarray:
    """256 flags: True where a byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words are runs of bytes other than space and \x09-\x0D.
SPACE_WORDS = separator_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of bytes other than \x00-\x2F, \x3A-\x60, \x7B-\x7F.
ALNUM_WORDS = separator_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_spans(b: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(start, end, document) of every word; words never cross documents."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[b]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(b))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.nonzero(m & ~before)[0]
    ends = np.nonzero(m & ~after)[0] + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


# ------------------------------------------------------------------ hashes
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, P odd. A worker keeps those of a
    chunk; those of a longer text go with it."""
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"], _POWERS["down"]
    p, out = 0xD6E8FEB86659FD93, {}
    for key, base in (("up", p), ("down", pow(p, -1, 1 << 64))):
        a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        a[0] = 1
        out[key] = np.cumprod(a, dtype=np.uint64)
    if n <= CHUNK_BYTES + 1:
        _POWERS.update(out)
    return out["up"], out["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    return mix64(h * _MULT + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (ordered)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = mix64(h * _MULT + words[i:n + i])
    return h


# -------------------------------------------------------------- task sums
class Tally:
    """Sums of counts by hash; ``part`` is a function of the hash."""

    def __init__(self):
        self.h, self.part, self.n, self.rows = [], [], [], 0

    def add(self, h: np.ndarray, part: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(h):
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
            total = np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n[order], first)
            self.h.append(h[first])
            self.part.append(part[order[first]])
            self.n.append(total)
            self.rows += len(first)

    def compact(self) -> None:
        if len(self.h) < 2:
            return
        h, part, n = np.concatenate(self.h), np.concatenate(self.part), np.concatenate(self.n)
        self.__init__()
        self.add(h, part, n)

    def take(self):
        """(hash, part, count) arrays of all so far; starts anew."""
        self.compact()
        out = (self.h[0], self.part[0], self.n[0]) if self.h else None
        self.__init__()
        return out


# ------------------------------------------------------------ range numbers
def range_numbers(df: DataFrame, key: str, n: int, out: str, samples_per_range: int = 64) -> DataFrame:
    """Add the number (from 0) of the key range a row belongs to. The bounds
    are quantiles of a sample chosen by a hash of the key, so that equal input
    always gives equal ranges, whatever its partitions or retries; the sample
    is bounded by ``n * samples_per_range`` expected keys. NULL keys go first."""
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    total = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    rate = max(1, total // (n * samples_per_range))
    pick = df.select(F.col(key).cast("double").alias("k")).where(
        F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key)), F.lit(rate)) == 0))
    keys = sorted(r["k"] for r in pick.collect())
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    if not bounds:
        return df.withColumn(out, F.lit(0))
    tmp = df.withColumn("_range_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_range_key", outputCol="_range_no")
    return cut.transform(tmp).withColumn(out, F.col("_range_no").cast("int")).drop("_range_key", "_range_no")
