"""Vectorised word and n-gram hashing over Arrow text columns.

A batch of texts is one contiguous byte buffer plus offsets; words are found
with byte-class masks and hashed with a prefix polynomial, so no Python
object is made per word. All hashes are fixed functions of the bytes: any
executor, or a retry on another one, gives the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 21          # bytes hashed at a time
BATCH_ROWS = 256         # texts per Arrow batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, read by Spark (local or remote path)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the number of texts per Arrow batch, hence a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few splits over the cluster; a scan that already has
    enough splits is left alone."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 7919 + 13)) | np.uint64(1)


BYTE_CODE = constants(256, 1)


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte mask, True on the inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


# separators of the two word rules, before lower-casing (all ASCII, so bytes decide)
WHITESPACE = class_table((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = class_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

class WorkerCache(dict):
    """A dict that travels empty when a task's closure holds it."""

    def __reduce__(self):
        return (WorkerCache, ())


_POWERS = WorkerCache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(n, BLOCK + 4096)
        inv = pow(BASE, -1, 1 << 64)
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, inv, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buf = col.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8)[off[0]:off[-1]] if buf[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words' offsets per text."""
    is_sep = sep[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = is_sep[:-1]
    before |= edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = is_sep[1:]
    after |= edge[1:]
    word = ~is_sep
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every span; A-Z fold to a-z when ``lower``."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
            j = min(j, n)
            seg = data[lo:ends[j - 1]]
            if lower:
                seg = LOWER[seg]
            up, down = _powers(len(seg) + 1)
            pref = np.zeros(len(seg) + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[seg] * up[:len(seg)], out=pref[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((pref[e] - pref[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def shingles(words: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of every text; a text of
    fewer words is one shingle, a text of none has none."""
    c = constants(k, 2)
    out = []
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        if n > 0:
            grams = words[:n] * c[0]
            for i in range(1, k):
                grams = grams + words[i:n + i] * c[i]
            grams = mix(grams + np.uint64(k))
        for a, b in zip(off[:-1], off[1:]):
            m = b - a
            if m >= k:
                out.append(np.unique(grams[a:b - k + 1]))
            elif m:
                out.append(mix(np.array([int(sum(int(w) * int(x) for w, x in zip(words[a:b], c)) + int(m)) & MASK], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def string_list(col) -> list[str]:
    """Python strings of a text column, null as empty."""
    return ["" if t is None else t for t in col.to_pylist()]


def segments(off: np.ndarray, block: int = BLOCK):
    """Byte segments of bounded size with the text index of each byte."""
    total = int(off[-1])
    for lo in range(0, total, block):
        hi = min(lo + block, total)
        d0 = int(np.searchsorted(off, lo, "right")) - 1
        d1 = int(np.searchsorted(off, hi - 1, "right")) - 1
        own = np.minimum(off[d0 + 1:d1 + 2], hi) - np.maximum(off[d0:d1 + 1], lo)
        yield lo, hi, np.repeat(np.arange(d0, d1 + 1), own)


def gram_buckets(data: np.ndarray, off: np.ndarray, n: int, bits: int, lo: int, hi: int, doc: np.ndarray):
    """Hash buckets of the byte ``n``-grams that start in [lo, hi) and the
    texts they belong to; none crosses the end of its text."""
    stop = min(hi, len(data) - n + 1)
    if stop <= lo:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = doc[:stop - lo]
    ok = np.arange(lo, stop) <= off[doc + 1] - n
    code = np.full(stop - lo, n * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
    for j in range(n):
        code = (code ^ data[lo + j:stop + j]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - bits))[ok].astype(np.int64), doc[ok]


def gram_counts(data: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of hashed byte n-grams, texts x buckets, over whole texts."""
    rows, width = len(off) - 1, 1 << bits
    out = np.zeros((rows, width), dtype=np.float32)
    for lo, hi, doc in segments(off):
        d0, d1 = int(doc[0]), int(doc[-1]) + 1
        for n in sizes:
            bucket, own = gram_buckets(data, off, n, bits, lo, hi, doc)
            if len(bucket):
                out[d0:d1] += np.bincount((own - d0) * width + bucket, minlength=(d1 - d0) * width).reshape(d1 - d0, width)
    return out
