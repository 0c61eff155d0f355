"""Statistics of requests, keys and values."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: As many groups have their brackets sent to all tasks, some 200 bytes each.
FEW_GROUPS = 100_000


def prefix_counts(keys: DataFrame, longest: int) -> DataFrame:
    """How many keys start with each prefix of up to ``longest`` characters: the nodes of a radix tree."""
    cut = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("key"))))
    return keys.select("key", cut.alias("depth")).groupBy(F.expr("left(key, depth)").alias("prefix")).agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, by: list[Column], points: tuple[float, ...], *sums: Column, accuracy: int = 10_000) -> DataFrame:
    """``sums`` of (by, value) by group, and for each point the least value that this share of its values, none a null, does not exceed.

    Exact, in three scans. A sketch of bounded size brackets each point; what lies below and up to a bracket is counted; only
    values on the side that holds the point's rank are put in order. That is the bracket, some 6 of ``accuracy`` values, if the
    sketch keeps its bound, else all on one side of it: a sketch decides on the work, never on a result. Groups are counted
    first: up to ``FEW_GROUPS`` their brackets are sent to the values, which stay where they are; more meet them in a shuffle.
    A stream is read once, so its state holds how often each value of a group came.
    """
    named = [f"p{str(p)[2:]}" for p in points]
    if rows.isStreaming:
        return rows.groupBy(*by).agg(*sums, *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in zip(named, points)])
    rows = rows.select(F.struct(*by).alias("group"), "*")
    few = rows.select("group").distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    meet = lambda told: rows.select("group", "value").join(F.broadcast(told) if few else told, "group")
    shares = [min(max(p + far / accuracy, 0.0), 1.0) for p in points for far in (-2, 2)]
    cuts = rows.groupBy("group").agg(F.count("value").alias("held"), *sums, F.percentile_approx("value", shares, accuracy).alias("cuts"))
    told = [c for c in cuts.columns if c not in ("group", "cuts")]
    cuts = cuts.select("group", *told, *[F.col("cuts")[2 * i + j].alias(n + end) for i, n in enumerate(named) for j, end in enumerate(("_lo", "_hi"))])
    value, carried = F.col("value"), [F.any_value(c).alias(c) for c in cuts.columns[1:]]
    counts = [F.count_if(c).alias(n + end) for n in named for c, end in ((value < F.col(f"{n}_lo"), "_below"), (value <= F.col(f"{n}_hi"), "_upto"))]
    asked = []
    for n, p in zip(named, points):
        rank, below, upto = F.ceil(F.col("held") * F.lit(Decimal(str(p)))).cast("long"), F.col(f"{n}_below"), F.col(f"{n}_upto")
        side = F.when(rank <= below, 0).when(rank <= upto, 1).otherwise(2)
        left = rank - F.when(side == 0, 0).when(side == 1, below).otherwise(upto)
        asked.append(F.struct(F.lit(n).alias("name"), side.alias("side"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"), left.alias("left")))
    asked = meet(cuts).groupBy("group").agg(*carried, *counts).select("group", *told, F.inline(F.array(*asked)))
    there = F.when(F.col("side") == 0, value < F.col("lo")).when(F.col("side") == 1, value.between(F.col("lo"), F.col("hi"))).otherwise(value > F.col("hi"))
    near = meet(asked).where(F.coalesce(there, F.col("held") == 0)).groupBy("group", "name", "value").agg(F.count("*").alias("count"), *[F.any_value(c).alias(c) for c in ("left", *told)])
    near = near.withColumn("upto", F.sum("count").over(Window.partitionBy("group", "name").orderBy("value"))).where(F.col("upto") >= F.col("left"))
    found = near.groupBy("group").agg(*[F.any_value(c).alias(c) for c in told], *[F.min(F.when(F.col("name") == n, value)).alias(n) for n in named])
    return found.select("group.*", *told[1:], *named)


def latency(requests: DataFrame, points: tuple[float, ...] = (0.9, 0.999), accuracy: int = 10_000) -> DataFrame:
    """Count, mean and percentiles by command, each a value that occurs and exact; ``accuracy`` is that of the sketch they are looked for with."""
    return percentiles(requests, [F.col("cmd")], points, F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), accuracy=accuracy)


def rolling_latency(requests: DataFrame, age: str = "60 seconds", step: str = "12 seconds", accuracy: int = 10_000) -> DataFrame:
    """Count and exact percentile of (cmd, ts, value) over the last ``age`` at every ``step``: sliding windows, also of a stream."""
    windows = F.window(F.col("ts").cast("timestamp"), age, step).alias("w")
    out = percentiles(requests, [windows, F.col("cmd")], (0.9,), F.count("*").alias("n"), accuracy=accuracy)
    return out.select(F.unix_seconds("w.end").alias("until"), "cmd", "n", "p9")


def sample_groups(samples: DataFrame, least: int, most_bytes: int) -> DataFrame:
    """Samples for a dictionary of each prefix: in order until ``most_bytes`` are full, where more than ``least`` are there.

    Only the first samples of a prefix can fill it, ``most_bytes`` of at least a byte each: Spark keeps no more rows of a
    prefix before the shuffle, so a hot one is no larger task than others. Empty samples count as one byte for that.
    """
    by = Window.partitionBy("prefix").orderBy("seq")
    first = samples.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most_bytes + 1)
    running = F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("running", running).where(F.col("running") - F.col("bytes") < most_bytes).groupBy("prefix").agg(F.count("*").alias("taken"), F.sum("bytes").alias("bytes"))
    counted = samples.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return kept.join(counted, "prefix").select("prefix", "taken", "bytes")


def compress_stats(requests: DataFrame) -> DataFrame:
    """By name of (name, raw, packed, us): what was packed is what got smaller; all else is stored raw and counts as it is."""
    smaller = F.col("packed") < F.col("raw")
    sums = requests.groupBy("name").agg(
        F.count("*").alias("raw_count"), F.count_if(smaller).alias("compressed_count"), F.sum("raw").alias("raw_total"),
        F.sum(F.when(smaller, F.col("packed")).otherwise(F.col("raw"))).alias("stored_total"), F.sum(F.when(smaller, F.col("us")).otherwise(0)).alias("us_total"))
    avg = F.when(F.col("compressed_count") > 0, F.round(F.col("us_total") / F.col("compressed_count"), 6))
    return sums.select("*", avg.alias("us_avg"), F.round(F.col("stored_total") / F.col("raw_total"), 6).alias("ratio"))


def packed_length(values: Column) -> Column:
    """Bytes of each value after zstd, in Arrow batches; needs the zstandard package."""
    @pandas_udf("long")
    def packed(held: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        return held.map(lambda v: None if v is None else len(pack(v.encode())))

    return packed(values)


def memory_sums(prepared: DataFrame) -> DataFrame:
    """(kind, mb) of memory set aside, by kind, and of all as ``all``."""
    return prepared.rollup("kind").agg(F.sum("mb").alias("mb")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "mb")


def slot_metrics(log: DataFrame, slot: Column, now_ms: int) -> DataFrame:
    """(slot, name, value) gauges of a change log: last seq, changes, keys, tombstones, and what share of changes is live."""
    from keyloom.plans.state import latest

    last = latest(log).withColumn("slot", slot)
    live = (F.col("op") != "del") & ((F.col("expire_at") == 0) | (F.col("expire_at") >= now_ms))
    keys = last.groupBy("slot").agg(F.max("seq").alias("last_seq"), F.count("*").alias("keys"), F.count_if(live).alias("live"))
    changes = log.groupBy(slot.alias("of")).agg(F.count("*").alias("changes"), F.count_if(F.col("op") == "del").alias("tombstones"))
    both = keys.join(changes, F.col("slot") == F.col("of"))
    gauges = {n: F.col(n).cast("double") for n in ("last_seq", "changes", "keys", "live", "tombstones")} | {"live_ratio": F.round(F.col("live") / F.col("changes"), 6)}
    return both.select("slot", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in gauges.items()])).alias("g")).select("slot", "g.name", "g.value")


def exposition(metrics: DataFrame, kind: str = "gauge") -> DataFrame:
    """(name, labels, value) as lines of a text scrape, in order: a line of its type before each name's values.

    ``labels`` is a map; labels come in the order of their names, with quotes, backslashes and line ends escaped.
    """
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    value = F.col("value").cast("double")
    number = F.when(value == F.floor(value), F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    lines = metrics.select("name", F.lit(1).alias("at"), F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), told, F.lit("}"))).otherwise(""), F.lit(" "), number).alias("line"))
    heads = metrics.select("name").distinct().select("name", F.lit(0).alias("at"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(f" {kind}")).alias("line"))
    return heads.union(lines)
