"""Strings and keys (key, value, expire_at): lookups, byte edits, conditional sets, counters and expiry.

A key is seen until its expire_at has passed; 0 never passes. Every operator on keys takes ``now_ms`` and treats what has
expired as missing: reads do not find it, conditional writes may write over it, and what a write returns is without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(expire_at: Column, now_ms: int) -> Column:
    return (expire_at == 0) | (expire_at >= now_ms)


def live(k: DataFrame, now_ms: int) -> DataFrame:
    return k.where(visible(F.col("expire_at"), now_ms))


def get(k: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """GET / MGET of (idx, key) requests in order, repeats included; null for what is missing."""
    return requests.join(live(k, now_ms), "key", "left").select("idx", "key", "value")


def exists(k: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXISTS: how many requests find a key; repeats count again."""
    return requests.join(live(k, now_ms), "key", "left_semi").agg(F.count("*").alias("n"))


def length(k: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """STRLEN of (idx, key) requests in bytes, 0 for what is missing."""
    return get(k, requests, now_ms).select("idx", "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("len"))


def type_of(kinds: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """TYPE of (idx, key) requests over a table of each type, each of keys that are alive; null for what is missing."""
    held = None
    for name, rows in kinds.items():
        own = rows.join(requests.select("key").distinct(), "key", "left_semi").select("key").distinct().withColumn("type", F.lit(name))
        held = own if held is None else held.union(own)
    return requests.join(held, "key", "left").select("idx", "key", "type")


def expire_at(kind: Column, n: Column, now_ms: int) -> Column:
    """When what EX, PX, EXAT or PXAT says expires, in epoch milliseconds; 0, never, without one and for PERSIST."""
    return F.coalesce(F.when(kind == "EX", now_ms + n * 1000).when(kind == "PX", now_ms + n).when(kind == "EXAT", n * 1000).when(kind == "PXAT", n), F.lit(0)).cast("long")


def byte_range(value: Column, start: int, end: int) -> Column:
    """GETRANGE: bytes start..end, negatives from the end, clamped."""
    b = value.cast("binary")
    n = F.octet_length(b)
    lo = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    hi = F.least(n - 1, F.lit(end) if end >= 0 else n + end)
    return F.when(hi >= lo, F.substring(b, lo + 1, hi - lo + 1)).otherwise(F.lit(b"")).cast("string")


def set_range(value: Column, offset: int, new: str) -> Column:
    """SETRANGE: the bytes from the offset overwritten, with zero bytes up to it. A null value is an empty one."""
    b, n = F.coalesce(value.cast("binary"), F.lit(b"")), len(new.encode())
    head = F.substring(b, 1, offset)
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.lit(offset) - F.octet_length(b))))
    return F.concat(head, zeros, F.lit(new.encode()), F.substring(b, F.lit(offset + n + 1), F.greatest(F.lit(0), F.octet_length(b) - offset - n))).cast("string")


def append(k: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """APPEND of (idx, key, value) rows in order; the expiry goes."""
    more = new.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("more"))
    return live(k, now_ms).join(more, "key", "right").select("key", F.concat(F.coalesce("value", F.lit("")), F.array_join(F.col("more.value"), "")).alias("value"), F.lit(0).cast("long").alias("expire_at"))


def put(k: DataFrame, new: DataFrame, now_ms: int, only: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """SET of (idx, key, value, expire_at), the last wins; NX sets missing keys, the first wins; XX sets present ones.

    ``old`` is what SET .. GET returns, null for a missing key.
    """
    pick = F.min_by if only == "NX" else F.max_by
    n = new.groupBy("key").agg(pick(F.struct("value", "expire_at"), "idx").alias("n"))
    takes = F.col("n").isNotNull() & {"NX": F.col("value").isNull(), "XX": F.col("value").isNotNull()}.get(only or "", F.lit(True))
    expire = F.when(takes, F.coalesce("expire_at", "n.expire_at") if keep_ttl else F.col("n.expire_at")).otherwise(F.col("expire_at"))
    out = live(k, now_ms).join(n, "key", "full").select("key", F.when(takes, F.col("n.value")).otherwise(F.col("value")).alias("value"), expire.alias("expire_at"), F.col("value").alias("old"))
    return out.where("value is not null")


def put_timed(k: DataFrame, new: DataFrame, now_ms: int, only: str | None = None) -> DataFrame:
    """SET .. EX / PX / EXAT / PXAT, SETEX and PSETEX of (idx, key, value, kind, n)."""
    return put(k, new.select("idx", "key", "value", expire_at(F.col("kind"), F.col("n"), now_ms).alias("expire_at")), now_ms, only)


def increase(k: DataFrame, deltas: DataFrame, now_ms: int) -> DataFrame:
    """INCR, DECR, INCRBY and DECRBY of (key, delta): sums, from 0 where there is no number."""
    d = deltas.groupBy("key").agg(F.sum("delta").alias("delta"))
    return d.join(live(k, now_ms), "key", "left").select("key", (F.coalesce(F.col("value").try_cast("bigint"), F.lit(0)) + F.col("delta")).cast("long").alias("value"))


def delete(k: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    return live(k, now_ms).join(gone, "key", "left_anti")


def take(k: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """GETDEL: the values that go."""
    return live(k, now_ms).join(asked.select("key").distinct(), "key", "left_semi").select("key", "value")


def copy(k: DataFrame, pairs: DataFrame, now_ms: int, replace: bool = False, remove: bool = False) -> DataFrame:
    """COPY and, with ``replace`` and ``remove``, RENAME, of (src, dst): missing sources do nothing."""
    k = live(k, now_ms)
    made = pairs.join(k, F.col("src") == F.col("key")).select(F.col("dst").alias("key"), "value", "expire_at", "src")
    if not replace:
        made = made.join(k.select("key"), "key", "left_anti")
    rest = k.join(made.select("key"), "key", "left_anti")
    if remove:
        rest = rest.join(made.select(F.col("src").alias("key")), "key", "left_anti")
    return rest.select("key", "value", "expire_at").union(made.select("key", "value", "expire_at"))


def expire(k: DataFrame, given: DataFrame, now_ms: int, only: str | None = None) -> DataFrame:
    """EXPIRE of (key, at): NX if there is none, XX if there is, GT or LT if it moves so; never counts as endless."""
    was, at = F.col("expire_at"), F.col("at")
    rule = {"NX": was == 0, "XX": was != 0, "GT": (was != 0) & (at > was), "LT": (was == 0) | (at < was)}.get(only or "", F.lit(True))
    takes = at.isNotNull() & rule
    return live(k, now_ms).join(given, "key", "left").select("key", F.when(takes, at).otherwise(was).alias("expire_at"), F.coalesce(takes, F.lit(False)).cast("int").alias("reply"))


def get_expire(k: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """GETEX of (key, kind, n): the values asked for and what they expire at after EX, PX, EXAT, PXAT or PERSIST; without one it stays."""
    held = live(k, now_ms).join(asked, "key")
    return held.select("key", "value", F.when(F.col("kind").isNull(), F.col("expire_at")).otherwise(expire_at(F.col("kind"), F.col("n"), now_ms)).alias("expire_at"))


def ttl(expire_at: Column, now_ms: int, unit_ms: int = 1000) -> Column:
    """TTL / PTTL: what is left in units, -1 for never, -2 for expired or missing."""
    left = F.floor((expire_at - now_ms) / unit_ms).cast("long")
    return F.when(expire_at.isNull(), -2).when(expire_at == 0, -1).when(expire_at < now_ms, -2).otherwise(left).cast("long")


def expire_time(expire_at: Column, now_ms: int, unit_ms: int = 1000) -> Column:
    """EXPIRETIME / PEXPIRETIME: when it expires in units, -1 for never, -2 for expired or missing."""
    at = F.floor(expire_at / unit_ms).cast("long")
    return F.when(expire_at.isNull(), -2).when(expire_at == 0, -1).when(expire_at < now_ms, -2).otherwise(at).cast("long")
