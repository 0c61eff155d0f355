"""Hashes (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(h: DataFrame, requests: DataFrame) -> DataFrame:
    """HGET, HMGET, HSTRLEN and HEXISTS of (idx, key, field) requests, in order, null for what is missing."""
    found = requests.join(h, ["key", "field"], "left")
    return found.select("idx", "key", "field", "value", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("len"), F.col("value").isNotNull().cast("int").alias("found"))


def wide(h: DataFrame, fields: list[str]) -> DataFrame:
    """HMGET of the same fields for all keys, one column a field."""
    return h.where(F.col("field").isin(fields)).groupBy("key").pivot("field", fields).agg(F.first("value"))


def put(h: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """HSET of (idx, key, field, value) rows, the last wins; with ``only_new`` HSETNX, where the first wins."""
    n = new.groupBy("key", "field").agg((F.min_by if only_new else F.max_by)("value", "idx").alias("given"))
    value = F.coalesce("value", "given") if only_new else F.coalesce("given", "value")
    return h.join(n, ["key", "field"], "full").select("key", "field", value.alias("value"))


def delete(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone, ["key", "field"], "left_anti")


def increase(h: DataFrame, deltas: DataFrame) -> DataFrame:
    """HINCRBY of (key, field, delta) on what reads as a whole number; missing fields count from 0."""
    d = deltas.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    return h.join(d, ["key", "field"], "right").select("key", "field", (F.coalesce(F.col("value").try_cast("bigint"), F.lit(0)) + F.col("delta")).alias("value"))


def increase_float(h: DataFrame, deltas: DataFrame) -> DataFrame:
    """HINCRBYFLOAT: each operand to two places away from zero, added as decimals."""
    from keyloom.functions.numbers import up2

    d = deltas.groupBy("key", "field").agg(F.sum(up2(F.col("delta"))).alias("delta"))
    was = F.coalesce(up2(F.col("value").try_cast("double")), F.lit(0).cast("decimal(20,2)"))
    return h.join(d, ["key", "field"], "right").select("key", "field", (was + F.col("delta")).cast("double").alias("value"))
