"""Helpers shared by the operators: words and their hashes, written tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode only, where that is unset, a new one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="doseframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The tables written in the scope of `scratch`, if there is one.
SCRATCH: ContextVar[list[str] | None] = ContextVar("SCRATCH", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within are deleted at its end: what is read later must have been written elsewhere."""
    made: list[str] = []
    token = SCRATCH.set(made)
    try:
        yield
    finally:
        SCRATCH.reset(token)
        for path in made:
            delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make() as a table in the shared folder; the tables that operators write on the way are deleted once it is there."""
    path, outer = shared_path(spark, label), SCRATCH.get()
    if outer is not None:
        outer.append(path)
    with scratch(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/doseframe/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if (made := SCRATCH.get()) is not None:
        made.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of frames that are gone once the driver has collected them; this asks it to collect now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bounded number of words."""

    def __init__(self, seed: int = 0, most: int = 120_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multiplier of the hashes of word sequences.
STEP = 0x9E3779B97F4A7C15


def gram_hashes(words: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
    """A hash of each n consecutive words, from the words' hashes; empty with fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    out, p = np.zeros(count, np.uint64), 1
    for j in range(n):
        out += words[j : j + count] * np.uint64(p)
        p = p * step & M64
    return mix(out + np.uint64(n))


def window_sums(words: np.ndarray, n: int, step: int) -> np.ndarray:
    """As gram_hashes for long windows, by doubling: sums over 1, 2, 4, ... words are put together."""
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    total, at = np.zeros(count, np.uint64), 0
    power, width = words, 1
    factor, q = step, 1
    while True:
        if n & width:
            total += power[at : at + count] * np.uint64(q)
            at += width
            q = q * pow(step, width, 1 << 64) & M64
        if width * 2 > n:
            return mix(total)
        power = power[:-width] + power[width:] * np.uint64(factor)
        factor = factor * factor & M64
        width *= 2


#: Rows and bytes of text that a task hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows and BATCH_BYTES at most, however long its texts are."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not 0 < int(now.removesuffix("b")) <= most:
            conf.set(key, str(most))
    return df


#: glibc's option for the size from which a block of memory is its own mapping, and that size.
M_MMAP_THRESHOLD, OWN_MAPPING = -3, 2 << 20


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, so that large arrays go back to the system once they are freed, and after it the rest that it has freed: Python
    workers live on between tasks."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        with contextlib.suppress(AttributeError, OSError):  # glibc has it
            ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, OWN_MAPPING)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a text column without decoding it."""
    return column.cast(pa.binary()).to_pylist()


#: A key is hot if it holds so many rows, and one in HOT_SHARE of all rows at least: so there are HOT_SHARE such keys at most.
HOT_ROWS, HOT_SHARE = 1000, 1000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str, label: str) -> DataFrame:
    """left.join(right, keys, how) for a right side with one row a key; how is inner or left.

    Rows of hot keys meet theirs by broadcast (HOT_SHARE rows at most), so that no task gets all rows of one key; the
    others are joined by a shuffle. Keys aren't null. left is read three times, and should be a written table."""
    spark, total = left.sparkSession, left.count()
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(HOT_ROWS, -(-total // HOT_SHARE))).select(*keys)
    hot = spark.createDataFrame(hot.collect(), hot.schema)  # HOT_SHARE rows at most
    if hot.isEmpty():
        return left.join(right, keys, how)
    own = written(right.join(F.broadcast(hot), keys, "left_semi"), f"{label}-hot")
    warm = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(own), keys, how)
    return warm.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def connected_components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) for links (a, b): component is the smallest node reachable.

    Smallest-neighbour labels with pointer jumping; each round is a written table, and the driver sees one count a round."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{label}-labels")
    while True:
        near = joined(both, labels.select(F.col("node").alias("b"), F.col("component").alias("c")), ["b"], "inner", label).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = written(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("c")), f"{label}-step")
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written(joined(step, jump, ["c"], "left", label).select("node", "was", F.least("c", F.coalesce("further", "c")).alias("component")), f"{label}-labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
