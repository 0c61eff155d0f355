"""Where a key belongs: hash tag, slot, bucket, split, worker, volume and their spread. The hash comes of MD5, which all engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, BUCKETS, GROUP, WORKERS = 8, 4096, 32, 3
#: A bucket holds so many keys before it is split in three, and in nine after that.
CELLS, STEP, MOST_SPLITS = 48, 3, 9


def hash_of(key: Column) -> Column:
    """A signed number of 60 bits: the first 15 hexadecimal digits of MD5, negative where the next is 8 or more."""
    digest = F.md5(key.cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") * F.when(F.substring(digest, 16, 1) < "8", 1).otherwise(-1)


def hash_tag(key: Column) -> Column:
    """What stands between the last ``{`` and the last ``}`` if that comes later; else the key."""
    last = lambda c: F.when(F.contains(key, F.lit(c)), F.length(key) - F.instr(F.reverse(key), c) + 1).otherwise(0)
    return F.when((last("{") > 0) & (last("}") > last("{")), F.substring(key, last("{") + 1, last("}") - last("{") - 1)).otherwise(key)


def slot(key: Column, slots: int = SLOTS, buckets: int = BUCKETS) -> Column:
    """The sign of the tag's hash picks the half, and what is above its bucket the place in it."""
    if slots == 1:
        return F.lit(0).cast("long")
    half, h = slots // 2, hash_of(hash_tag(key))
    # Whole numbers divided towards zero.
    place = F.abs(F.call_function("div", h, F.lit(half * buckets)) % half)
    return F.when(h > 0, place).otherwise(half + place).cast("long")


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.abs(hash_of(key) % buckets).cast("long")


def split(key: Column, parts: int = STEP) -> Column:
    return F.abs(F.call_function("shiftright", hash_of(key), F.lit(32)) % parts).cast("long")


def wal_group(key: Column) -> Column:
    return F.floor(bucket(key) / GROUP).cast("long")


def worker(slot: Column, workers: int = WORKERS) -> Column:
    return (slot % workers).cast("long")


def skew(keys: DataFrame) -> DataFrame:
    """Keys of each slot and bucket group."""
    return keys.groupBy(slot(F.col("key")).alias("slot"), wal_group(F.col("key")).alias("wal_group")).agg(F.count("*").alias("n"))


def bucket_splits(keys: DataFrame, buckets: int = BUCKETS, cells: int = CELLS) -> DataFrame:
    """(slot, bucket, n, splits): into how many parts each bucket is cut for its keys to fit, three times as many until they do, nine at most."""
    held = keys.groupBy(slot(F.col("key")).alias("slot"), bucket(F.col("key"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    return held.withColumn("splits", F.when(F.col("n") <= cells, 1).when(F.col("n") <= cells * STEP, STEP).otherwise(MOST_SPLITS))


def volumes(slots: DataFrame, ranges: str) -> DataFrame:
    """(slot, volume) by a list like ``/mnt/a:0-3,/mnt/b:4-7``; null for a slot in no range."""
    parts = [(d, *map(int, r.split("-"))) for d, r in (x.split(":") for x in ranges.split(","))]
    return slots.select("slot", F.coalesce(*[F.when(F.col("slot").between(lo, hi), F.lit(d)) for d, lo, hi in parts]).alias("volume"))


def snowflake(ms: Column, node: int, place: Column) -> Column:
    """An identifier in the order of time: milliseconds, 10 bits of node, 12 bits of place."""
    return F.shiftleft(ms, 22).bitwiseOR(F.lit(node << 12).cast("long")).bitwiseOR(place.cast("long"))


def snowflake_parts(identifier: Column) -> list[Column]:
    """The milliseconds, the data centre and the machine, 5 bits each, and the place of an identifier."""
    return [F.shiftright(identifier, 22).alias("ms"), F.shiftright(identifier, 17).bitwiseAND(F.lit(31)).alias("centre"), F.shiftright(identifier, 12).bitwiseAND(F.lit(31)).alias("machine"), identifier.bitwiseAND(F.lit(4095)).alias("place")]


def is_ipv4(text: Column) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"  # fixed value
    return F.coalesce(text.rlike(rf"\A{part}(\.{part}){{3}}\z"), F.lit(False))
