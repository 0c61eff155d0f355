"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, pick, small_batches
from keyloom.llm.lsm import RunIndex

BLANKS = " \t\n\x0b\x0c\r"
#: Repeated keys, of 16 bytes each, that may be sent to all workers.
MOST_KEYS = 200_000
#: A level's runs beyond which they are compacted; fewer than the batches, as no level would ever be full.
FANOUT = 2
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(LOWER)


def line_hash(key: str) -> bytes:
    """128 bits, so that equal hashes mean equal keys for any corpus that can be stored."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(key.encode())


def line_hashes(docs: DataFrame, least_chars: int = 20, batches: int = 4) -> DataFrame:
    """(key binary, doc_id, batch): each key of a document once, if it is long enough."""
    small_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            keys, ids = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {line_hash(k) for line in (text or "").split("\n") if len(line) >= least_chars and len(k := line_key(line)) >= least_chars}
                keys += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "key binary, doc_id long").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


def repeated_lines(work: Workspace, lines: DataFrame, least_docs: int, batches: int) -> DataFrame:
    """(key, last_id): the keys found in enough documents, each with the largest doc_id that holds it.

    Batches come one by one: each is counted, merge-anti-joined against the runs and adds the keys that are new as a run
    of its own; what older runs have already is a hit, and adds to their counts. So every key is in one run, and documents
    belong to one batch.
    """
    index = RunIndex(work, "key", {"n_docs": F.sum("n_docs"), "last_id": F.max("last_id")}, FANOUT)
    hits = None
    for k in range(batches):
        counted = lines.where(F.col("batch") == k).select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
        name, own = index.bucketed(counted)
        if not index.runs():
            index.flush((name, own))
            continue
        fresh = index.bucketed(index.new(own))
        old = work.table(own.join(fresh[1].select("key"), "key", "left_anti"), f"hits-{k}")
        hits = old if hits is None else hits.union(old)
        index.flush(fresh)
        index.drop(name)
    if hits is None:
        hits = lines.select("key", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("last_id")).limit(0)
    more = work.table(hits.groupBy("key").agg(F.sum("n_docs").alias("more"), F.max("last_id").alias("later")).select(F.col("key").alias("of"), "more", "later"), "more")
    found = [run.join(more, F.col("key") == F.col("of"), "left").where(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= least_docs).select("key", F.greatest("last_id", "later").alias("last_id")) for run in index.runs()]
    return reduce(DataFrame.union, found)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, most_keys: int = MOST_KEYS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, text, n_lines, n_dropped), the text without the lines that lost.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Long enough keys found in enough documents
    keep their lines in the largest doc_id that holds them, repeats within it included. Null and empty texts are one
    empty line, long ones are read whole. Rows with one doc_id count as one document; rows with a null doc_id count as
    one too, lose lines like others, and never are the largest. Other columns of ``docs`` do not matter, and an empty
    table gives an empty one. Up to ``most_keys`` repeated keys are sent to all workers, which then need no other row;
    of more, each document gets the keys that it loses.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    lines = work.table(line_hashes(docs, least_chars, batches), "lines")
    repeated = work.table(repeated_lines(work, lines, least_docs, batches), "repeated")

    def cut(texts: list[str | None], losing: list[Callable[[bytes], bool] | None], ids: pa.Array) -> pa.RecordBatch:
        kept, n_lines, n_dropped = [], [], []
        for text, loses in zip(texts, losing, strict=True):
            all_lines = (text or "").split("\n")
            left = all_lines
            if loses:
                left = [x for x in all_lines if len(x) < least_chars or len(k := line_key(x)) < least_chars or not loses(line_hash(k))]
            kept.append("\n".join(left))
            n_lines.append(len(all_lines))
            n_dropped.append(len(all_lines) - len(left))
        return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    told = "doc_id long, text string, n_lines long, n_dropped long"
    if repeated.count() <= most_keys:
        got = repeated.toArrow()
        last_of = spark.sparkContext.broadcast(dict(zip(got["key"].to_pylist(), got["last_id"].to_pylist(), strict=True)))

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = last_of.value
            for b in found:
                ids = b.column(0).to_pylist()
                yield cut(b.column(1).to_pylist(), [lambda key, own=i: key in last and last[key] is not None and last[key] != own for i in ids], b.column(0))

        return pick(docs, "doc_id", "text").mapInArrow(run, told)

    lost = lines.join(repeated, "key").where(F.coalesce(F.col("doc_id") != F.col("last_id"), F.col("last_id").isNotNull()))
    lost = work.table(lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost")).select(F.col("doc_id").alias("of"), "lost"), "lost")

    def run_each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield cut(b.column(1).to_pylist(), [set(keys).__contains__ if keys else None for keys in b.column(2).to_pylist()], b.column(0))

    # The text side is streamed past a hash table of the lost keys, without a sort of texts.
    joined = pick(docs, "doc_id", "text").join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(run_each, told)
