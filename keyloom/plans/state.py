"""State from a change log (seq, key, op, value, delta, expire_at): last write wins, tombstones, expiry, mixed edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The change of highest seq of each key; aggregated before the shuffle, so hot keys cost no more than others."""
    return log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value", "expire_at"), "seq").alias("s")).select("key", "s.*")


def visible(log: DataFrame, now_ms: int) -> DataFrame:
    """Keys whose last change is no tombstone and has not expired."""
    return latest(log).where((F.col("op") != "del") & ((F.col("expire_at") == 0) | (F.col("expire_at") >= now_ms)))


def after_flush(log: DataFrame) -> DataFrame:
    """FLUSHDB: changes after the last flush, all without one. The one row of that is a scalar subquery's."""
    last = log.agg(F.max(F.when(F.col("op") == "flush", F.col("seq"))).alias("flushed"))
    return log.join(F.broadcast(last), F.col("flushed").isNull() | (F.col("seq") > F.col("flushed"))).where("op <> 'flush'").drop("flushed")


def counters(log: DataFrame) -> DataFrame:
    """Counters under mixed set, incr and del: the last set or del of a key starts from 0, and what comes later adds up.

    Keys whose last change is a del are absent. Both steps aggregate before the shuffle, so a hot key is no large task.
    """
    own = log.where("op in ('set', 'incr', 'del')")
    reset = F.col("op").isin("set", "del")
    last = own.groupBy("key").agg(F.max(F.when(reset, F.col("seq"))).alias("reset"), F.max_by("op", "seq").alias("last_op"))
    added = own.join(last, "key").where((F.col("op") == "incr") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset")))).groupBy("key").agg(F.sum("delta").alias("value"))
    return last.where("last_op <> 'del'").join(added, "key", "left").select("key", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Replay of a batch of changes onto a state of the same columns; order and repeats make no difference."""
    return latest(state.select("seq", "key", "op", "value", "expire_at").union(changes.select("seq", "key", "op", "value", "expire_at")))


def valid(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows within the limits of key and value length."""
    out = F.octet_length("key") <= limits["key"]
    return rows.where(out & (F.octet_length("value") <= limits["value"]))


def valid_sizes(rows: DataFrame, most: int) -> DataFrame:
    """Keys whose collection has more elements than the limit allows, with their size."""
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)


def writable(log: DataFrame, readonly: DataFrame, slot: Column) -> DataFrame:
    """The read-only guard: changes of slots that are not set read-only, in order of arrival."""
    return log.withColumn("slot", slot).join(readonly, "slot", "left_anti")


def config_json(settings: DataFrame) -> DataFrame:
    """(name, value) settings as one JSON object, by name."""
    return settings.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("config"))
