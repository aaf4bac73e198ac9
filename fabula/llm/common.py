"""Shared tools: written tables, size-checked semi-joins, vectorised words and shingles, components.

Arrow batches are bounded in bytes (``bounded_batches``), and their texts are handled as NumPy arrays in slices of at
most ``SLICE`` characters (or one text), so that memory does not depend on how long rows are or how many.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 19
SHINGLE = 5
#: A table is broadcast up to this many rows and bytes; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 8 << 20
#: Of an Arrow batch that Python workers get.
BATCH_BYTES = 8 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD_BYTE = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD_BYTE[_c] = True
_WORD_BYTE[128:] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fabula-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (or one row) for the session's Python workers, whatever the rows' size."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back. Survives lost executors."""
    path = f"{shared_dir(spark)}/fabula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fabula_path = path
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._fabula_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()  # Spark's cleaner deletes shuffle files of plans that are no longer referenced


def tidy(function: Callable) -> Callable:
    """``function`` for mapInPandas, after which a Python worker gives memory back that it no longer uses.

    Workers are kept from stage to stage, and what operators cache, or glibc and Arrow hold back for later, would add up.
    """
    owner = function.__module__

    def run(batches):
        import sys

        for name, module in list(sys.modules.items()):
            if name.startswith(__package__) and name != owner:
                for cache in getattr(module, "CACHES", ()):
                    cache.clear()
        try:
            yield from function(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def small_or_shuffled(rows: DataFrame, size: Column | int = 16) -> DataFrame:
    """``rows`` (a written table) with a broadcast hint if a look at no more than that proves it to be small.

    ``size``: bytes of a row, as a number or an expression for rows that hold lists.
    """
    seen = rows.select((F.lit(size) if isinstance(size, int) else size).cast("long").alias("size")).limit(BROADCAST_ROWS + 1)
    n, total = seen.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else rows


def slices(texts: list, limit: int = SLICE, of: list | None = None) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts (and those beside them in ``of``) have at most ``limit`` characters together, or one text."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        own = len(t) + (len(of[j]) if of else 0)
        if size and size + own > limit:
            yield i, j
            i, size = j, 0
        size += own
    if i < len(texts):
        yield i, len(texts)


def clean(texts) -> list[str]:
    """Null texts are empty texts."""
    return [t if isinstance(t, str) else "" for t in texts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        _pow, _inv = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INV, dtype=np.uint64)
        _pow[0] = _inv[0] = 1
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow, _inv


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hashes`` gives the hash of any span from them."""
    p, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of several texts: runs of ASCII letters and digits and of all non-ASCII characters.

    ``hash``: one 64-bit hash a word; ``offset[i]:offset[i+1]``: the words of text i; ``start``/``end``: byte
    positions in ``data``, where text i begins at ``begin[i]``.
    """

    def __init__(self, texts: list[str], ascii_only: bool = False):
        raw = [(t if ascii_only else t.lower()).encode("utf-8", "surrogatepass") for t in texts]
        self.begin = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(b) + 1 for b in raw], out=self.begin[1:])
        self.data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = _WORD_BYTE[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.sums = prefix_hashes(_ASCII_LOWER[self.data] if ascii_only else self.data)
        self.hash = span_hashes(self.sums, self.start, self.end)
        self.offset = np.searchsorted(self.start, self.begin)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def shingles(words: np.ndarray, offset: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the offsets; a text of 1 to k-1 words has one shingle of all."""
    n = np.diff(offset)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.zeros(len(offset), dtype=np.int64)
    np.cumsum(count, out=out_off[1:])
    at = np.arange(out_off[-1]) + np.repeat(offset[:-1] - out_off[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        out = out * _P + np.where(j < length, padded[at + j], np.uint64(0))
    return mix(out + length.astype(np.uint64)), out_off


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of one type: rows (node, root), root the smallest node reached.

    Alternating small-star and large-star steps (Kiveris et al., 2014) on edges a < b until every node hangs on one
    root. Each turn is one plan over a written table, whose minima come from partial aggregates, so that a hot node's
    rows can be split; nothing is collected.
    """
    live = written(spark, edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = live.select(F.col("a").alias("v"), F.lit(1).alias("head"), F.lit(0).alias("tail")).unionByName(live.select(F.col("b").alias("v"), F.lit(0).alias("head"), F.lit(1).alias("tail")))
        if ends.groupBy("v").agg(F.max("head").alias("head"), F.sum("tail").alias("tail")).where("tail > 1 or head = 1 and tail = 1").isEmpty():
            break
        low = live.groupBy("b").agg(F.min("a").alias("low"))
        small = live.join(low, "b").select("low", F.explode(F.array("a", "b")).alias("b")).where("low < b").select(F.col("low").alias("a"), "b").distinct()
        low = small.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("low"))
        turn = written(spark, small.join(low, "a", "left").select(F.coalesce("low", "a").alias("a"), "b").distinct())
        forget(spark, live)
        live = turn
    star = live.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return star.unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
