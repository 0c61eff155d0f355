"""Exact dedup with a log-structured merge index of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Bloom, Workspace, build_bloom, pick, small_batches
from keyloom.llm.lsm import RunIndex

BLANKS = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, n_chars, sha256 hex, digest hex): the digest is the SHA-256's first bytes, all of them but in tests."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sums = [hashlib.sha256(normalised(t)).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(sums, pa.string()), pa.array([s[: 2 * digest_bytes] for s in sums], pa.string())], ["doc_id", "n_chars", "sha256", "digest"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, sha256 string, digest string")


def memtables(entries: DataFrame, most: int = 100_000) -> DataFrame:
    """(digest, doc_id, n_chars) rows through memtables of at most ``most`` digests, each flushed sorted by digest.

    A memtable holds, of each digest, the best row so far and the count of all, so a group of any size leaves one
    entry a memtable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = sorted(table.items())
            table.clear()
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                best = pa.StructArray.from_arrays([pa.array([r[0] for _, r in part], pa.int64()), pa.array([r[1] for _, r in part], pa.int64())], ["n_chars", "doc_id"])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.string()), best, pa.array([r[2] for _, r in part], pa.int64())], ["digest", "best", "group_size"])

        for b in batches:
            for digest, doc_id, n_chars in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (held := table.get(digest)) is None:
                    if len(table) >= most:
                        yield from flushed()
                    table[digest] = [n_chars, doc_id, 1]
                else:
                    held[2] += 1
                    if n_chars > held[0] or n_chars == held[0] and doc_id is not None and (held[1] is None or doc_id < held[1]):
                        held[:2] = n_chars, doc_id
        yield from flushed()

    return entries.select("digest", "doc_id", "n_chars").mapInArrow(run, "digest string, best struct<n_chars:long,doc_id:long>, group_size long")


def _low(digest: str, digest_bytes: int) -> Column:
    """A digest's first 64 bits, as the filters take them."""
    return F.conv(F.rpad(F.substring(digest, 1, 16), min(16, 2 * digest_bytes), "0"), 16, -10).cast("long")


def _index(work: Workspace, entries: DataFrame, batches: int, low: Column) -> DataFrame:
    """(digest, best, group_size) of every digest that several rows share.

    Each batch flushes a run of its digests. Those that it holds several times are shared, and so are those that pass the
    filter of older runs and are found there. Only shared digests are read from all runs and put together.
    """
    best = F.min_by("best", F.struct((-F.col("best.n_chars")).alias("n"), F.col("best.doc_id").isNull().alias("none"), F.col("best.doc_id").alias("doc_id")))
    index = RunIndex(work, "digest", {"best": best, "group_size": F.sum("group_size")})
    expected, hits = entries.count(), []
    for k in range(batches):
        name, run = index.bucketed(index.merged([memtables(entries.where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)) == k))]))
        found = run.where("group_size > 1").select("digest").union(index.old(run, low))
        hits.append(work.table(found, f"hits-{k}"))
        index.flush((name, run))
        if k + 1 < batches:
            index.note(run.select(low.alias("h")), expected)
    shared = work.table(reduce(DataFrame.union, hits).distinct(), "shared")
    return work.table(index.merged([run.join(shared, "digest", "left_semi") for run in index.runs()]), "index")


def _texts_of(docs: DataFrame, hits: Bloom, digest_bytes: int) -> DataFrame:
    """(doc_id, n_chars, digest, body) of the documents whose digest passes the filter."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bodies = [normalised(t) for t in texts]
            sums = [hashlib.sha256(x).hexdigest()[: 2 * digest_bytes] for x in bodies]
            passed = hits.has(np.array([int(s[:16], 16) for s in sums], np.uint64))
            if passed.any():
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(sums, pa.string()), pa.array(bodies, pa.binary())], ["doc_id", "n_chars", "digest", "body"])
                yield pc.filter(out, pa.array(passed))

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, digest string, body binary")


def exact_duplicates(docs: DataFrame, batches: int = 4, digest_bytes: int = 32) -> DataFrame:
    """Every row of ``docs`` as (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes without ASCII blanks are; null counts as empty, and long texts are read whole.
    Documents reach the index in batches: memtables collapse each batch, runs flush sorted by digest, and what is put
    together keeps the best row of each digest. Digests that several rows share are hits, whose bytes are compared with
    those of the row that stays; rows that differ, which takes a collision, are indexed anew under their whole bytes. A
    row is kept if it carries keep_id and its length, so rows repeated with one doc_id are kept alike; rows with a null
    doc_id are never preferred to others of their length and have a null keep_id and kept = true only where all of the
    group lack one. Other columns of ``docs`` do not matter, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    low = _low("digest", digest_bytes)
    table = work.table(digests(docs, digest_bytes), "digests")
    index = _index(work, table, batches, low)
    count = index.count()
    if count:
        bodies = work.table(_texts_of(docs, build_bloom(index.select(low.alias("h")), count), digest_bytes), "bodies")
        stays = bodies.join(index.select(F.col("digest").alias("of"), F.col("best.doc_id").alias("keep"), F.col("best.n_chars").alias("keep_chars")), (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("n_chars") == F.col("keep_chars")))
        # A table of its own, so that the join may split a digest that very many share.
        stays = work.table(stays.groupBy("digest").agg(F.min("body").alias("keep_body")).select(F.col("digest").alias("of"), "keep_body"), "stays")
        odd = bodies.join(stays, F.col("digest") == F.col("of")).where("body <> keep_body").select("doc_id", "n_chars", F.col("digest").alias("was"), F.hex("body").alias("body"))
        odd = work.table(odd, "collided")
        work.drop("bodies", "stays")
        if not odd.isEmpty():
            again = odd.select("doc_id", "n_chars", "was", F.concat_ws(":", "was", "body").alias("now")).distinct()
            clean = table.join(again, table.doc_id.eqNullSafe(again.doc_id) & (table.n_chars == again.n_chars) & (table.digest == again.was), "left").select(table.doc_id, table.n_chars, "sha256", F.coalesce("now", "digest").alias("digest"))
            table = work.table(clean, "digests-apart")
            index = _index(Workspace(spark, "exact-apart"), table, batches, low)
    found = index.select(F.col("digest").alias("of"), F.col("best.doc_id").alias("best_id"), F.col("best.n_chars").alias("keep_chars"), F.col("group_size").alias("shared_by"))
    many = F.col("of").isNotNull()
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return table.join(found, F.col("digest") == F.col("of"), "left").select(
        "doc_id", F.when(many, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("shared_by", F.lit(1)).cast("long").alias("group_size"), F.when(many, stays).otherwise(True).alias("kept"), F.col("sha256").alias("text_sha256")
    )
