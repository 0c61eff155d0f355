"""Sorted sets (key, member, score): ranks, ranges, pops, conditional upserts and weighted algebra, over all keys at once.

Order is by score, then member. An operator on one key is a filter before it, which Catalyst pushes to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_key() -> WindowSpec:
    return Window.partitionBy("key")


def rank(z: DataFrame, rev: bool = False) -> DataFrame:
    """ZRANK / ZREVRANK: 0-based ``rank`` in order."""
    order = [F.desc("score"), F.desc("member")] if rev else ["score", "member"]
    return z.withColumn("rank", F.row_number().over(by_key().orderBy(*order)).cast("long") - 1)


def bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """Inclusive positions of start..stop in n elements, negatives from the end, clamped."""
    at = lambda k: F.lit(k) if k >= 0 else n + k
    return F.greatest(F.lit(0), at(start)), F.least(n - 1, at(stop))


def range_by_index(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """ZRANGE / ZREVRANGE with scores."""
    lo, hi = bounds(F.col("n"), start, stop)
    counted = rank(z, rev) if start >= 0 and stop >= 0 else rank(z, rev).withColumn("n", F.count("*").over(by_key()))
    lo, hi = (F.lit(start), F.lit(stop)) if start >= 0 and stop >= 0 else (lo, hi)
    return counted.where((F.col("rank") >= lo) & (F.col("rank") <= hi)).select("key", "rank", "member", "score")


def between(value: Column, low: object, high: object, open_low: bool = False, open_high: bool = False) -> Column:
    """An interval; None is no bound."""
    out = F.lit(True)
    if low is not None:
        out = out & ((value > F.lit(low)) if open_low else (value >= F.lit(low)))
    if high is not None:
        out = out & ((value < F.lit(high)) if open_high else (value <= F.lit(high)))
    return out


def limited(ranked: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """LIMIT per key over ``rank``; a count of 0 or less means all."""
    hi = None if count is None or count <= 0 else offset + count - 1
    return ranked.where(between(F.col("rank"), offset, hi))


def range_by_score(z: DataFrame, low: float | None, high: float | None, open_low: bool = False, open_high: bool = False, offset: int = 0, count: int | None = None, rev: bool = False) -> DataFrame:
    """ZRANGEBYSCORE / ZREVRANGEBYSCORE: the filter reaches the scan, ranks are within the range."""
    return limited(rank(z.where(between(F.col("score"), low, high, open_low, open_high)), rev), offset, count).select("key", "rank", "member", "score")


def range_by_lex(z: DataFrame, low: str | None, high: str | None, open_low: bool = False, open_high: bool = False, offset: int = 0, count: int | None = None, rev: bool = False) -> DataFrame:
    """ZRANGEBYLEX / ZREVRANGEBYLEX: by member alone."""
    order = F.desc("member") if rev else F.asc("member")
    held = z.where(between(F.col("member"), low, high, open_low, open_high)).withColumn("rank", F.row_number().over(by_key().orderBy(order)).cast("long") - 1)
    return limited(held, offset, count).select("key", "rank", "member")


def store(found: DataFrame, dst: str) -> DataFrame:
    """*STORE: the rows under another key."""
    return found.withColumn("key", F.lit(dst)).select("key", "member", "score")


def count_between(z: DataFrame, column: str, low: object, high: object, open_low: bool = False, open_high: bool = False) -> DataFrame:
    """ZCOUNT on score, ZLEXCOUNT on member; keys with none count 0."""
    return z.groupBy("key").agg(F.count_if(between(F.col(column), low, high, open_low, open_high)).alias("n"))


def pop(z: DataFrame, n: int, largest: bool = False) -> DataFrame:
    """ZPOPMIN / ZPOPMAX: the n first by key; Spark prunes the window to its top n before the shuffle."""
    return rank(z, largest).where(F.col("rank") < n).select("key", "rank", "member", "score")


def without(z: DataFrame, gone: DataFrame) -> DataFrame:
    """What (key, member) rows of ``gone`` leave: ZREM, the ZREMRANGE family and what a pop leaves."""
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti").select("key", "member", "score")


def increase(z: DataFrame, deltas: DataFrame) -> DataFrame:
    """ZINCRBY of (key, member, delta) rows; a missing member counts from 0."""
    d = deltas.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    return z.join(d, ["key", "member"], "full").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("score"))


def add(z: DataFrame, new: DataFrame, only: str | None = None) -> DataFrame:
    """ZADD of (idx, key, member, score) rows, as if one after the other; with ``changed`` for rows that are new or moved.

    ``only`` is NX (the first of new members), XX (present ones), GT or LT (present ones if greater or less, and new
    ones with their largest or smallest); without it the last row wins.
    """
    how = {"NX": F.min_by("score", "idx"), "GT": F.max("score"), "LT": F.min("score")}.get(only or "", F.max_by("score", "idx"))
    n = new.groupBy("key", "member").agg(how.alias("given"))
    was, given = F.col("score"), F.col("given")
    takes = {"NX": was.isNull(), "XX": was.isNotNull(), "GT": was.isNull() | (given > was), "LT": was.isNull() | (given < was), "": F.lit(True)}[only or ""]
    takes = F.coalesce(takes & given.isNotNull(), F.lit(False))
    out = z.join(n, ["key", "member"], "full").select("key", "member", F.when(takes, given).otherwise(was).alias("score"), F.coalesce(takes & (was.isNull() | (was != given)), F.lit(False)).alias("changed"))
    return out.where("score is not null")


def scores(z: DataFrame, requests: DataFrame) -> DataFrame:
    """ZSCORE / ZMSCORE: (idx, key, member) requests in order, a null score for what is missing."""
    return requests.join(z, ["key", "member"], "left").select("idx", "key", "member", "score")


def sample(z: DataFrame, n: int, seed: str) -> DataFrame:
    """ZRANDMEMBER, HRANDFIELD, SRANDMEMBER and SPOP: n a key in the order of md5(seed, member), the same every time."""
    name = "field" if "field" in z.columns else "member"
    return z.withColumn("place", F.row_number().over(by_key().orderBy(F.md5(F.concat(F.lit(seed), F.col(name))), name)).cast("long")).where(F.col("place") <= n)


def draw(z: DataFrame, n: int, seed: str) -> DataFrame:
    """ZRANDMEMBER, HRANDFIELD and SRANDMEMBER of a negative count: n draws a key, repeats allowed, the same every time.

    Each draw is 60 bits of md5(seed, key, draw), reduced to a place in the key's order by name. The number of rows is n a
    key, so the table itself is joined once with the places that were drawn.
    """
    name = "field" if "field" in z.columns else "member"
    sizes = z.groupBy("key").agg(F.count("*").alias("size"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    drawn = sizes.select("key", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("draw")).select("key", "draw", (hashed % F.col("size")).alias("place"))
    placed = z.withColumn("place", F.row_number().over(by_key().orderBy(name)).cast("long") - 1)
    return drawn.join(placed, ["key", "place"]).select("draw", *z.columns)


def add_increase(z: DataFrame, new: DataFrame, only: str | None = None) -> DataFrame:
    """ZADD .. INCR of one (key, member, score) each: (key, member, score) after, and the reply, the new score or null where NX, XX, GT or LT forbid it."""
    n = new.groupBy("key", "member").agg(F.sum("score").alias("delta"))
    was, after = F.col("score"), F.coalesce("score", F.lit(0.0)) + F.col("delta")
    takes = {"NX": was.isNull(), "XX": was.isNotNull(), "GT": was.isNull() | (after > was), "LT": was.isNull() | (after < was), "": F.lit(True)}[only or ""]
    out = z.join(n, ["key", "member"], "full").withColumn("takes", F.coalesce(takes & F.col("delta").isNotNull(), F.lit(False)))
    return out.select("key", "member", F.when(F.col("takes"), after).otherwise(was).alias("score"), F.when(F.col("takes"), after).alias("reply")).where("score is not null")


def algebra(z: DataFrame, keys: list[str], kind: str, weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZUNION, ZINTER and ZDIFF of ``keys``: one shuffle on the member, scores weighted before they are folded.

    A key may be named again, with another weight. A difference keeps the first key's scores. Scores are not rounded.
    """
    from keyloom.operators.sets import named

    fold = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    held = named(z, keys, weight=weights or [1.0] * len(keys)).groupBy("member").agg(fold(F.col("score") * F.col("weight")).alias("folded"), F.count("*").alias("n"), F.max(F.when(F.col("at") == 0, F.col("score"))).alias("first"))
    if kind == "diff":
        return held.where("n = 1 and first is not null").select("member", F.col("first").alias("score"))
    return (held.where(F.col("n") == len(keys)) if kind == "inter" else held).select("member", F.col("folded").alias("score"))
