"""Log segments: what is alive in them, what compaction keeps, runs of equal segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.state import latest


def marked(log: DataFrame, per_segment: int, now_ms: int) -> DataFrame:
    """Changes with their segment and whether they are alive: the last of their key, no tombstone, not expired."""
    last = latest(log).select("key", F.col("seq").alias("last"))
    alive = (F.col("seq") == F.col("last")) & (F.col("op") != "del") & ((F.col("expire_at") == 0) | (F.col("expire_at") >= now_ms))
    return log.join(last, "key").withColumn("segment", F.floor(F.col("seq") / per_segment).cast("long")).withColumn("alive", alive)


def liveness(log: DataFrame, per_segment: int, now_ms: int) -> DataFrame:
    return marked(log, per_segment, now_ms).groupBy("segment").agg(F.count_if("alive").alias("valid"), F.count_if(~F.col("alive")).alias("invalid"))


def compacted(log: DataFrame, per_segment: int, now_ms: int) -> DataFrame:
    return marked(log, per_segment, now_ms).where("alive").select("segment", "seq", "key")


#: What a segment can be, by its flag; the first, last and last but one can be written anew.
FLAGS = {"init": 100, "new_write": 0, "reuse_new": 10, "merging": 1, "merged": -1, "merged_and_persisted": -10, "reuse": -100}
REUSABLE = ["init", "reuse", "merged_and_persisted"]
#: Blocks of a segment, bytes of its head; merged segments and values that start a write, segments of one.
BLOCKS, HEAD = 4, 28
MERGED_SEGMENTS, MERGED_VALUES, ONCE = 256, 256 * 64, 8


def runs(segments: DataFrame, flag: str, range_bits: int = 16) -> DataFrame:
    """Runs of neighbouring segments with one flag: gaps and islands over one row a segment.

    Segments are numbered within ranges of 2 ** ``range_bits``, and runs that touch at a range's end are put together, so
    that no task holds all segments of a flag.
    """
    own = segments.withColumn("range", F.shiftright("segment", range_bits))
    at = F.col("segment") - F.row_number().over(Window.partitionBy(flag, "range").orderBy("segment"))
    parts = own.withColumn("island", at).groupBy(flag, "range", "island").agg(F.min("segment").alias("first"), F.max("segment").alias("last"))
    # A row a run and range: a run goes on where the one before ends right before it.
    by = Window.partitionBy(flag).orderBy("first")
    begins = (F.lag("last").over(by) + 1).eqNullSafe(F.col("first"))
    joined = parts.withColumn("run", F.sum(F.when(begins, 0).otherwise(1)).over(by)).groupBy(flag, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select(flag, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def contiguous(batches: DataFrame) -> DataFrame:
    """(batch, first, last, n, ok) of (batch, segment): whether a merge list has every segment from its first to its last."""
    held = batches.groupBy("batch").agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.count("*").alias("n"))
    return held.withColumn("ok", F.col("last") - F.col("first") + 1 == F.col("n"))


def packed(blocks: DataFrame, segment_bytes: int) -> DataFrame:
    """(group, segment, block, bytes, packed, sub_block) of (group, segment, block, bytes): blocks in order into as few segments as their order allows, BLOCKS at most and no more than fit beside the head.

    Whether a block opens a new segment depends on all before it in its group, which is a fold over the group's list;
    groups are those that are persisted at once, a few hundred blocks.
    """
    step = lambda acc, x: F.struct(
        F.when((acc["k"] == BLOCKS) | (acc["bytes"] + x["bytes"] > segment_bytes - HEAD), acc["at"] + 1).otherwise(acc["at"]).alias("at"),
        F.when((acc["k"] == BLOCKS) | (acc["bytes"] + x["bytes"] > segment_bytes - HEAD), 1).otherwise(acc["k"] + 1).alias("k"),
        F.when((acc["k"] == BLOCKS) | (acc["bytes"] + x["bytes"] > segment_bytes - HEAD), x["bytes"]).otherwise(acc["bytes"] + x["bytes"]).alias("bytes"),
        F.concat(acc["out"], F.array(F.struct(x["block"].alias("block"), x["bytes"].alias("bytes"), F.when((acc["k"] == BLOCKS) | (acc["bytes"] + x["bytes"] > segment_bytes - HEAD), acc["at"] + 1).otherwise(acc["at"]).alias("packed")))).alias("out"),
    )
    begun = F.struct(F.col("first").alias("at"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("bytes"), F.expr("cast(array() as array<struct<block:bigint,bytes:bigint,packed:bigint>>)").alias("out"))
    lists = blocks.groupBy("group").agg(F.min("segment").alias("first"), F.array_sort(F.collect_list(F.struct("block", "bytes"))).alias("held"))
    out = lists.select("group", F.explode(F.aggregate("held", begun, step, lambda acc: acc["out"])).alias("b")).select("group", "b.*")
    return out.withColumn("sub_block", F.row_number().over(Window.partitionBy("group", "packed").orderBy("block")).cast("long") - 1)


def oldest_merged(merged: DataFrame, once: int = ONCE, segments: int = MERGED_SEGMENTS, values: int = MERGED_VALUES) -> DataFrame:
    """FIFO: of merged values (slot, segment, wal_group, key) those of each slot's ``once`` first segments, where enough segments or values wait."""
    waiting = merged.groupBy("slot", "segment").agg(F.count("*").alias("n"))
    full = waiting.groupBy("slot").agg(F.sum("n").alias("values"), F.count("*").alias("segments")).where((F.col("values") >= values) | (F.col("segments") >= segments))
    first = waiting.join(full.select("slot"), "slot", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("segment"))).where(F.col("place") <= once)
    return merged.join(first.select("slot", "segment"), ["slot", "segment"], "left_semi")


def flag_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair]), name)


def flag_dump(flags: DataFrame, begin: int = 0, count: int = 0) -> DataFrame:
    """(segment, line) of (segment, flag, seq, wal_group): all, or ``count`` segments from ``begin`` on."""
    held = flags.where(F.col("segment").between(begin, begin + count - 1)) if count > 0 else flags
    return held.select("segment", F.concat_ws(", ", F.col("segment").cast("string"), "flag", F.col("seq").cast("string"), F.col("wal_group").cast("string")).alias("line"))


def next_flags(flags: DataFrame, steps: DataFrame) -> DataFrame:
    """(segment, flag) after the ``steps`` (segment, to): new_write only over what can be written anew, merging after a write, merged after merging, and so on; others stay."""
    allowed = {"new_write": REUSABLE, "reuse_new": REUSABLE, "merging": ["new_write", "reuse_new"], "merged": ["merging"], "merged_and_persisted": ["merged"], "reuse": ["merged_and_persisted"], "init": []}
    ok = F.lit(False)
    for to, before in allowed.items():
        ok = ok | ((F.col("to") == to) & F.col("flag").isin(before)) if before else ok
    return flags.join(steps, "segment", "left").select("segment", F.when(F.coalesce(ok, F.lit(False)), F.col("to")).otherwise(F.col("flag")).alias("flag"))
