"""Sets (key, member): algebra across keys, membership, moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(rows: DataFrame, keys: list[str], **values: list[float]) -> DataFrame:
    """The rows of ``keys``, once for each place ``at`` that names their key, with that place's ``values``."""
    places = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("at"), *[F.lit(float(v[i])).alias(n) for n, v in values.items()]) for i, k in enumerate(keys)])
    return rows.where(F.col("key").isin(keys)).withColumn("place", F.explode(F.filter(places, lambda p: p["key"] == F.col("key")))).select(*rows.columns, "place.at", *[f"place.{n}" for n in values])


def algebra(s: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """SDIFF (the first less the rest), SINTER and SUNION of distinct members: one filtered scan and one shuffle. A key may be named again: SDIFF a a is empty."""
    held = named(s, keys).groupBy("member").agg(F.count("*").alias("n"), F.bool_or(F.col("at") == 0).alias("first"))
    cond = {"diff": "first and n = 1", "inter": f"n = {len(keys)}", "union": "true"}[kind]
    return held.where(cond).select("member")


def store(members: DataFrame, dst: str) -> DataFrame:
    return members.select(F.lit(dst).alias("key"), "member")


def store_reply(found: DataFrame, dst: str) -> DataFrame:
    """(key, n, op) of a *STORE: the size of what is stored, and the change of the destination, a tombstone where it is empty."""
    return found.agg(F.count("*").alias("n")).select(F.lit(dst).alias("key"), "n", F.when(F.col("n") > 0, "set").otherwise("del").alias("op"))


def size_up_to(members: DataFrame, limit: int = 0) -> DataFrame:
    """SINTERCARD / ZINTERCARD: the size, cut at ``limit`` unless it is 0."""
    n = F.count("*")
    return members.agg((F.least(n, F.lit(limit).cast("long")) if limit else n).alias("n"))


def add(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").union(new.select("key", "member")).distinct()


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone, ["key", "member"], "left_anti")


def is_member(s: DataFrame, requests: DataFrame) -> DataFrame:
    """SISMEMBER / SMISMEMBER of (idx, key, member) requests: 1 or 0."""
    return requests.join(s.withColumn("found", F.lit(1)), ["key", "member"], "left").select("idx", "key", "member", F.coalesce("found", F.lit(0)).alias("found"))


def move(s: DataFrame, moves: DataFrame) -> DataFrame:
    """SMOVE of (src, dst, member): what the source has goes to the destination, all others stay."""
    found = s.join(moves, (s.key == moves.src) & (s.member == moves.member), "left_semi")
    hit = moves.join(s, (s.key == moves.src) & (s.member == moves.member), "left_semi").select(F.col("dst").alias("key"), "member")
    return s.join(found, ["key", "member"], "left_anti").union(hit).distinct()
