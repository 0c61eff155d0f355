"""What the operators share: working tables in the shared folder, Arrow batch sizes, Bloom filters, components."""

from __future__ import annotations

import atexit
import hashlib
import os
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the ASCII blanks, and nothing else.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Upper limits of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4000, 2 << 20

#: A Bloom filter sent to executors has at most so many bits (16 MB); a fuller one prunes less and loses nothing.
BLOOM_BITS = 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where it is unset, local mode gets a temporary one
    and a cluster an error, as each executor would write to a disk of its own.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        spark.conf.set("spark.checkpoint.dir", set_dir)
        atexit.register(_delete, spark, set_dir)
    return set_dir.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended, and with it the folder's use
        pass


#: Spark's setting that removes a query's shuffle files when the query ends, not when the driver's memory is next cleaned.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written to the shared folder, which end the lineage of what is read from them.

    A lost executor then costs its own tasks only. ``drop`` removes a table that no plan reads any more; what is
    left goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.top = spark, f"{shared_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, self.top)

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes ``df``, frees the shuffles that made it, and reads it."""
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.options(**options).mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before) if before else self.spark.conf.unset(FREE_SHUFFLES)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


#: Rows of a table of numbers that may be sent to every executor: 2.4 MB a column of longs.
SMALL_ROWS = 300_000


def few_or_hashed(df: DataFrame, rows: int, most: int = SMALL_ROWS) -> DataFrame:
    """The small side of a join: sent to all executors if its counted ``rows`` are few, else met in a shuffled hash table, so that the other side is never sorted."""
    return F.broadcast(df) if rows <= most else df.hint("shuffle_hash")


def driver_folder() -> str:
    """Where the driver keeps a small file that Spark copies to executors, as long as the interpreter runs."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="keyloom-"))
    atexit.register(shutil.rmtree, folder, True)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session, so that none needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_keyloom_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parents[1]
    files = sorted(top.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = os.path.join(driver_folder(), f"{top.name}-{mark}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
    sc._keyloom_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches, as texts may be very long, and readies the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


# Bloom filter over 64-bit hashes ------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Bloom:
    """Two bits a hash in a fixed number of 64-bit words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = _mix(hashes)
        out = np.ones(len(h), bool)
        for x in (h & self.mask, (h >> np.uint64(32)) * np.uint64(2654435761) & self.mask):
            out &= (self.words[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return out


def build_bloom(hashes: DataFrame, count: int) -> Bloom:
    """From one BIGINT column. Tasks send only the words they set, which Spark merges: at most BLOOM_BITS / 64 rows reach the driver."""
    import pyarrow as pa

    bits = 1 << 12
    while bits < min(BLOOM_BITS, 12 * max(count, 1)):
        bits *= 2

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        mask = np.uint64(bits - 1)
        for b in batches:
            h = _mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for x in (h & mask, (h >> np.uint64(32)) * np.uint64(2654435761) & mask):
                np.bitwise_or.at(words, (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        at = np.flatnonzero(words)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(words[part].view(np.int64))], ["at", "word"])

    merged = hashes.mapInArrow(set_bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    got = merged.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    if got.num_rows:
        words[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return Bloom(words)


# Connected components -----------------------------------------------------------------------------------------------


def components(work: Workspace, edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Of the graph of (a, b): every node with the smallest node it can reach, as (node, root).

    Alternates large-star and small-star steps until the edges no longer change. Minima are pre-aggregated, and each
    round's edges are written to the shared folder, so neither hubs nor long lineage gather in one place.
    """
    now = work.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges-0")
    mark = None
    for k in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = work.table(small.select("e.u", "e.v").where("u <> v").distinct(), f"edges-{k}")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        work.drop(f"edges-{k - 1}")
        now = after
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def per_batch(f: Callable) -> Callable:
    """For mapInArrow: ``f`` takes a batch and returns one, or None."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return run
