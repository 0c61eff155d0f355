"""Lists (key, pos, value), pos dense from 0: edits give fractional places, and one window numbers them anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keyloom.operators.zsets import bounds

def by_key() -> WindowSpec:
    return Window.partitionBy("key")


def size() -> Column:
    return F.count("*").over(by_key())


def dense(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.select("key", (F.row_number().over(by_key().orderBy(*(order or ("pos",)))).cast("long") - 1).alias("pos"), "value")


def index(ls: DataFrame, i: int) -> DataFrame:
    """LINDEX: from the end if negative; keys out of range have no row."""
    if i >= 0:
        return ls.where(F.col("pos") == i).select("key", "value")
    return ls.withColumn("n", size()).where(F.col("pos") == F.col("n") + i).select("key", "value")


def slice_(ls: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE, inclusive, negatives from the end."""
    if start >= 0 and stop >= 0:
        return ls.where((F.col("pos") >= start) & (F.col("pos") <= stop)).select("key", "pos", "value")
    lo, hi = bounds(F.col("n"), start, stop)
    return ls.withColumn("n", size()).where((F.col("pos") >= lo) & (F.col("pos") <= hi)).select("key", "pos", "value")


def trim(ls: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM; a stop still below 0 after counting from the end keeps element 0."""
    n = F.col("n")
    at = lambda k: F.lit(k) if k >= 0 else F.greatest(F.lit(0), n + k)
    held = ls.withColumn("n", size()).where((F.col("pos") >= at(start)) & (F.col("pos") <= at(stop)))
    return dense(held)


def positions(ls: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """LPOS: from the rank-th match on, from the tail if negative; a count of 0 means all."""
    held = ls.withColumn("n", size()) if rank < 0 and maxlen else ls
    if maxlen:
        held = held.where((F.col("pos") < maxlen) if rank > 0 else (F.col("pos") >= F.col("n") - maxlen))
    order = F.asc("pos") if rank > 0 else F.desc("pos")
    k = F.row_number().over(by_key().orderBy(order))
    held = held.where(F.col("value") == value).withColumn("k", k).where(F.col("k") >= abs(rank))
    return (held.where(F.col("k") < abs(rank) + count) if count else held).select("key", "pos")


def push(ls: DataFrame, new: DataFrame, left: bool = False, existing: bool = False) -> DataFrame:
    """LPUSH / RPUSH of (key, idx, value); LPUSHX / RPUSHX with ``existing``."""
    if existing:
        new = new.join(ls.select("key").distinct(), "key", "left_semi")
    both = ls.select("key", F.lit(0).alias("side"), F.col("pos").alias("at"), "value").union(new.select("key", F.lit(-1 if left else 1).alias("side"), (-F.col("idx") if left else F.col("idx")).alias("at"), "value"))
    return dense(both, "side", "at")


def insert(ls: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """LINSERT at the first pivot of each key that has one."""
    at = ls.where(F.col("value") == pivot).groupBy("key").agg((F.min("pos") + (-0.5 if before else 0.5)).alias("pos")).select("key", "pos", F.lit(value).alias("value"))
    return dense(ls.select("key", F.col("pos").cast("double").alias("pos"), "value").union(at))


def put(ls: DataFrame, i: int, value: str) -> DataFrame:
    """LSET; keys out of range stay as they are."""
    at = F.lit(i) if i >= 0 else size() + i
    return ls.withColumn("at", at).select("key", "pos", F.when(F.col("pos") == F.col("at"), value).otherwise(F.col("value")).alias("value"))


def remove(ls: DataFrame, n: int, value: str) -> DataFrame:
    """LREM: the first n matches, the last -n, or all for 0. Only matches are ranked; then one window numbers what is left."""
    hits = ls.where(F.col("value") == value)
    if n:
        k = F.row_number().over(by_key().orderBy(F.asc("pos") if n > 0 else F.desc("pos")))
        hits = hits.withColumn("k", k).where(F.col("k") <= abs(n))
    return dense(ls.join(hits.select("key", "pos"), ["key", "pos"], "left_anti") if n else ls.where((F.col("value") != value) | F.col("value").isNull()))


def pop(ls: DataFrame, n: int, right: bool = False) -> DataFrame:
    """LPOP / RPOP: the elements taken."""
    if not right:
        return ls.where(F.col("pos") < n).select("key", "pos", "value")
    return ls.withColumn("n", size()).where(F.col("pos") >= F.col("n") - n).select("key", "pos", "value")


def move(ls: DataFrame, moves: DataFrame, from_right: bool, to_right: bool) -> DataFrame:
    """LMOVE / RPOPLPUSH of (src, dst): one element each; an emptied list is absent."""
    end = F.max("pos") if from_right else F.min("pos")
    ends = ls.groupBy("key").agg(end.alias("pos")).join(moves, F.col("key") == F.col("src"), "left_semi")
    taken = ls.join(ends, ["key", "pos"])
    left = ls.join(ends, ["key", "pos"], "left_anti")
    moved = taken.join(moves, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), F.lit(0).alias("idx"), "value")
    return push(left, moved, left=not to_right)
