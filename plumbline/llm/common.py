"""What the operators of this subpackage share: scratch tables, ranks without a global window, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many bytes may be broadcast; beyond that a join shuffles.
BROADCAST_BYTES = 8 << 20

_serial = itertools.count()
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_run = uuid.uuid4().hex


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches: rows hold whole texts, and thousands of long ones would fill a worker's memory. And no union
    of equally dealt tables counts as dealt alike: with adaptive plans Spark 4.1 then groups one key in several tasks."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 64:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only on a single machine that names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables that cut lineage: Parquet in the shared checkpoint folder, so a lost executor loses nothing.

    They are deleted when dropped, or when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_root(spark).rstrip('/')}/plumbline-{_run}/{name}-{next(_serial)}"
        self.rows = 0  # about how many rows narrow tables have, once known
        atexit.register(self.close)

    def save(self, df: DataFrame, files: int | None = None, narrow: bool = False) -> DataFrame:
        """files: at most so many. narrow: short rows that come out of a shuffle, in at most two files a core, or more if
        `rows` says so; each file costs its writer a process on file systems that set permissions through one."""
        if narrow:
            files = max(2 * self.spark.sparkContext.defaultParallelism, self.rows // 500_000)
        path = f"{self.base}/{next(_serial)}"
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def sweep(self) -> None:
        """Has Spark delete the shuffle files of finished jobs: it does once the driver's garbage collector finds that no
        plan holds them, which a driver with free memory may put off until they have piled up on the executors' disks."""
        gc.collect()
        for _ in range(2):  # what Python let go of reaches the JVM a moment later
            time.sleep(0.5)
            self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is temporary anyway
            pass

    def close(self) -> None:
        self._delete(self.base)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a table for broadcast if its counted size is under BROADCAST_BYTES; else leaves it to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes else df


def unit(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def bucketed(df: DataFrame, keys: list[str], at: str, n: int, weight: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds rank (from 0, gapless) of each row within its keys in the order of `at`, a double in [0, 1),
    and with `weight` also `before`, the sum of weights of earlier rows.

    No window spans a key: rows fall in about sqrt(n) buckets of `at` that hold about sqrt(n) rows each; a prefix
    sum over bucket totals shifts the ranks found inside buckets. n: rows of df. Rows equal in every column are
    interchangeable, others with equal `at` are put in the order of `ties`, by default all their columns."""
    per = max(64.0, n**0.5 / 2)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    null_safe = lambda a, b, ks: [a[k].eqNullSafe(b[k]) for k in ks]
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    x = df.join(small(sizes, 64), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    x = x.withColumn("_b", F.floor(F.col(at) * F.ceil(F.col("_n") / F.lit(per)))).drop("_n", *[f"_k{i}" for i in range(len(keys))])
    w = F.col(weight) if weight else F.lit(0)
    totals = x.groupBy(*keys, "_b").agg(F.count("*").alias("_rows"), F.sum(w).alias("_sum"))
    run = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_rows").over(run), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(at, *([c for c in df.columns if c not in keys and c != at] if ties is None else ties))
    x = x.withColumn("rank", F.row_number().over(inside) - 1)
    if weight:
        x = x.withColumn("before", F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(small(totals, 64), [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b") == F.col("_kb")], "left")
    x = x.withColumn("rank", (F.col("rank") + F.col("_r0")).cast("long"))
    if weight:
        x = x.withColumn("before", (F.col("before") + F.col("_s0")).cast("long"))
    return x.drop("_b", "_kb", "_r0", "_s0", *[f"_k{i}" for i in range(len(keys))])


_held: dict[str, object] = {}


def held(name: str, make):
    """make()'s value, kept in this worker process under `name` for later tasks. Only the last name's value is kept: a
    worker that turns to another operator lets go of what the one before remembered."""
    if name not in _held:
        _held.clear()
        lean()
        _held[name] = make()
    return _held[name]


def lean() -> None:
    """Gives freed memory of this worker process back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def release() -> None:
    """Lets go of what another operator's tasks kept in this worker process."""
    if _held:
        _held.clear()
        lean()


def leanly(run, holds: bool = False):
    """Wraps a function over Arrow batches: lean() after the last. holds: it uses held() itself."""

    def wrapped(batches):
        if not holds:
            release()
        yield from run(batches)
        lean()

    return wrapped


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it has grown, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Runs of bytes, characters or words are named by polynomials at this point, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, at least."""
    global _up, _down
    if len(_up) <= n:
        size = max(2 * len(_up), n + 1)
        _up, _down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _up, _down


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of small numbers: of a polynomial over each, mixed."""
    up, down = powers(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ h >> np.uint64(32)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of words(text), in order, without a step in Python for each."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    solid = np.concatenate([[False], ~_space[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return run_hashes(data, edges[::2], edges[1::2])


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; all words as one run if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    h = hashes[: n - k + 1].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += hashes[i : n - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)
