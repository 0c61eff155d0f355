"""Percentiles of more values than a sketch holds one by one."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from keyloom.plans import metrics


def nearest(values, point):
    """The least value that a share of ``point`` does not exceed; NaN is the largest, nulls are no values."""
    held = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return held[max(math.ceil(Fraction(str(point)) * len(held)), 1) - 1] if held else None


def plain(rows):
    return {tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows}


ODD = [("one", 7.0), ("ten", None), ("none", None), ("none", None), (None, 3.0), (None, 1.0), ("nan", math.nan), ("nan", 2.0), ("inf", math.inf), ("inf", -math.inf), ("zero", -0.0), ("zero", 0.0)]
MIXED = ODD + [("ten", float(v)) for v in range(10)] + [("same", 5.0)] * 300 + [("many", float(v * 7919 % 5003)) for v in range(5003)] + [("most", float(v % 3)) for v in range(1000)]


def told(points):
    groups = {}
    for cmd, v in MIXED:
        groups.setdefault(cmd, []).append(v)
    return plain((cmd, len(vs), *[nearest(vs, p) for p in points]) for cmd, vs in groups.items())


def test_latency_is_exact_beyond_the_sketch(spark):
    """More values of a command than the sketch's default accuracy of 10,000."""
    n = 60_000
    got = metrics.latency(spark.range(0, n, 1, 7).select(F.lit("get").alias("cmd"), (F.col("id") * 7919 % n).cast("double").alias("value"))).first()
    assert (got.n, got.mean, got.p9, got.p999) == (n, (n - 1) / 2, n * 0.9 - 1, n * 0.999 - 1)


@pytest.mark.parametrize("accuracy", [1, 3, 50, 10_000])
def test_latency_of_any_accuracy(spark, accuracy):
    points = (0.05, 0.5, 0.9, 0.999)
    rows = spark.createDataFrame(MIXED, "cmd string, value double").repartition(5)
    assert plain(metrics.latency(rows, points, accuracy).drop("mean").collect()) == told(points)


@pytest.mark.parametrize("cuts", [(-9.0, -8.0), (2.0, 4.0), (1e9, 2e9), (4.0, 2.0)])
def test_latency_where_the_sketch_misses(spark, monkeypatch, cuts):
    """Brackets below, beside, above the point, and turned round."""
    points = (0.5, 0.999)
    rows = spark.createDataFrame(MIXED, "cmd string, value double")
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda *_: F.array(*[F.lit(c) for c in cuts * 2]))
    assert plain(metrics.latency(rows, points).drop("mean").collect()) == told(points)


def test_latency_of_many_commands(spark, monkeypatch):
    """Brackets that are not sent to all tasks."""
    monkeypatch.setattr(metrics, "FEW_GROUPS", 2)
    rows = spark.createDataFrame(MIXED, "cmd string, value double")
    assert plain(metrics.latency(rows, (0.9, 0.999), 20).drop("mean").collect()) == told((0.9, 0.999))
    assert not metrics.latency(rows.limit(0)).collect()


def timed(spark, n):
    """Values of two commands over four minutes, in a mixed order, some null."""
    at = F.timestamp_seconds(1_704_067_200 + F.col("id") % 240)
    value = F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % n).cast("double"))
    return spark.range(0, n, 1, 7).select(F.when(F.col("id") % 5 == 0, "set").otherwise("get").alias("cmd"), at.alias("ts"), value.alias("value"))


def windows(requests):
    """What (until, cmd, n, p9) of 60 seconds every 12 are, by hand."""
    held = {}
    for cmd, ts, v in requests:
        end = ts // 12 * 12 + 12
        for until in range(end, end + 60, 12):
            held.setdefault((until, cmd), []).append(v)
    return {(*k, len(vs), nearest(vs, 0.9)) for k, vs in held.items()}


def test_rolling_latency_is_exact_beyond_the_sketch(spark):
    rows = timed(spark, 240_000)
    want = windows(rows.select("cmd", F.unix_seconds("ts"), "value").collect())
    assert len(want) == 48 and max(n for _, _, n, _ in want) == 48_000
    assert plain(metrics.rolling_latency(rows).collect()) == want


def test_rolling_latency_of_a_stream(spark, tmp_path):
    """Files that come one after another give what they give at once, beyond what the sketch holds."""
    rows = timed(spark, 3_000)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = metrics.rolling_latency(stream, accuracy=20).writeStream.format("memory").queryName("rolled").outputMode("complete")
    out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = windows(rows.select("cmd", F.unix_seconds("ts"), "value").collect())
    assert plain(spark.table("rolled").collect()) == plain(metrics.rolling_latency(rows, accuracy=20).collect()) == want
